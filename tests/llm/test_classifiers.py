import math
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import ppm_language, subword_quality
from tests.llm.fixtures import documents, frame, prose


def brute_ppm(texts, order, symbols):
    """Counts of each context, kept like the model keeps them, and the method C code length of a text."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    for text in texts:
        b = [256] * order + list(text.encode())
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][tuple(b[i - k : i])][b[i]] += 1
    return counts


def brute_bits(counts, keep, order, text, known):
    b = [256] * order + [x if x in known else -1 for x in text.encode()]

    def p(k, ctx, s):
        if k < 0:
            return 1 / 257
        lower = p(k - 1, ctx[1:], s)
        if k and ctx not in keep[k]:
            return lower
        seen = counts[k].get(ctx, {})
        total, kinds = sum(seen.values()), len(seen)
        if not total:
            return lower
        return seen[s] / (total + kinds) if s in seen else kinds / (total + kinds) * lower

    return sum(round(-math.log2(p(order, tuple(b[i - order : i]), b[i])) * ppm_language.UNIT) for i in range(order, len(b)))


def test_code_lengths_equal_brute_force():
    rng = random.Random(3)
    training = {"en": [prose(rng, "en", 40) for _ in range(4)], "fr": [prose(rng, "fr", 40) for _ in range(4)]}
    order = 3
    rows = defaultdict(int)
    for lang, texts in training.items():
        for t in texts:
            b = [256] * order + list(t.encode())
            for i in range(order, len(b)):
                code = 0
                for x in b[i - order : i + 1]:
                    code = code * 257 + x
                rows[lang, code] += 1
    model = ppm_language.build_model(sorted((lang, g, n) for (lang, g), n in rows.items()), order)
    assert model["order"] == order
    counts = {lang: brute_ppm(texts, order, None) for lang, texts in training.items()}
    keep = {lang: [{c for c, s in counts[lang][k].items() if sum(s.values()) >= ppm_language.LEAST_USES} for k in range(order + 1)] for lang in counts}
    known = {x for texts in training.values() for t in texts for x in t.encode()}
    texts = [prose(rng, "en", 9), prose(rng, "fr", 9), "", "é", "ZZ\x00 ±", "a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = ppm_language.code_lengths(model, raw, offsets)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [brute_bits(counts[lang], keep[lang], order, t, known) for lang in ("en", "fr")]


def test_any_number_of_languages_keeps_the_order_and_the_code_lengths():
    rng = random.Random(9)
    rows = []
    for k in range(21):
        counts = defaultdict(int)
        for _ in range(400):
            counts[sum((97 + rng.randrange(3 + k % 5)) * 257**j for j in range(4))] += 1
        rows += [(f"l{k:02}", g, n) for g, n in counts.items()]
    raw, offsets = np.frombuffer(b"abcabcaabbcc\xc3\xa9cab", np.uint8), np.array([0, 9, 19])
    together = ppm_language.build_models(rows)
    assert len(together) == 3 and all(m["order"] == ppm_language.ORDER for m in together)
    got = np.hstack([ppm_language.code_lengths(m, raw, offsets) for m in together])
    alone = np.hstack([ppm_language.code_lengths(ppm_language.build_model([r for r in rows if r[0] == f"l{k:02}"]), raw, offsets) for k in range(21)])
    assert np.array_equal(got, alone)


def test_language_contract(spark):
    rows = documents(n=300)
    got = ppm_language.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    judged = [r for r in got if r.held_out and lang[r.doc_id] and len(text[r.doc_id] or "") > 40]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.97 * len(judged)
    assert ppm_language.identify(frame(spark, [])).count() == 0
    untrained = ppm_language.identify(frame(spark, [(1, "words", None, "s", 0, 1, "x")])).first()
    assert (untrained.lang_pred, untrained.score) == ("und", 0.0)


def junk(rng):
    word = rng.choice(["Zab", "Tion", "Erle"])
    return " ".join([word] * rng.randint(40, 90)) if rng.random() < 0.5 else " ".join(f"{w.upper()}!!" for w in prose(rng, "en", 60).split())


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.8
        docs.append((i, prose(rng, rng.choice(["en", "fr"]), 80) if good else junk(rng), "en", "s", 0, 1, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_contract_and_held_out_accuracy(spark, labelled):
    docs, labels = labelled
    odd = [(None, "no id", "en", "s", 0, 1, "x"), (900, None, None, None, 0, 1, "x"), (901, "", "en", "s", 0, 1, "x"), (902, "   ", "en", "s", 0, 1, "x"), (0, docs[0][1], "en", "s", 0, 1, "x")]
    df = frame(spark, docs + odd)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = subword_quality.score_quality(df, marks).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    again = subword_quality.score_quality(df.repartition(3), marks).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)


def test_quality_without_both_classes_and_filter(spark, labelled):
    docs, labels = labelled
    df = frame(spark, docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in subword_quality.score_quality(df, none).collect()} == {0.5}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = subword_quality.keep_good(df, marks)
    wanted = {r.doc_id for r in subword_quality.score_quality(df, marks).collect() if r.predicted}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == wanted
    assert subword_quality.score_quality(frame(spark, []), marks).count() == 0


def test_vectorised_features_equal_one_text_at_a_time():
    texts = ["abc abc\nd", "", "é x x", "a", "word" * 50, "日本 語🙂🙂 Ж", "", "\u07ff\u0800\uffff\U00010000"]
    raw, offsets = subword_quality.code_points(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    assert raw.tolist() == list(map(ord, "".join(texts))) and offsets.tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    margin = np.random.default_rng(0).normal(size=1 << subword_quality.BUCKET_BITS).astype(np.float32)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, inside in subword_quality.gram_features(raw, offsets):
        owner = np.searchsorted(offsets, np.arange(len(raw)), side="right") - 1
        total += np.bincount(owner, np.where(inside, margin[bucket], 0), len(texts))
        count += np.bincount(owner, inside, len(texts))
    starts, bucket = subword_quality.word_features(raw, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    total += np.bincount(owner, margin[bucket], len(texts))
    count += np.bincount(owner, minlength=len(texts))
    for i, t in enumerate(texts):
        ids, share = subword_quality.sparse_features(t)
        want = float(share @ margin[ids]) if len(ids) else 0.0
        assert abs(want - total[i] / max(1, count[i])) < 1e-5


def plain_features(text):
    """Shares of the hashed character grams, words and word pairs of a text, one after the other."""

    def bucket(h):
        h &= 2**32 - 1
        return (((h ^ (h >> 15)) * 0x9E3779B1) & (2**32 - 1)) >> (32 - subword_quality.BUCKET_BITS)

    found = []
    for n in (3, 4, 5):
        for i in range(len(text) - n + 1):
            h = 0x811C9DC5
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c) + 1) & (2**32 - 1)
            found.append(bucket(h))
    hashes = [sum((ord(c) + 1) * 0x100000001B3**k for k, c in enumerate(w)) & (2**64 - 1) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found += [bucket(h ^ (h >> 32)) for h in hashes]
    for a, b in zip(hashes, hashes[1:], strict=False):
        pair = (a * 0x100000001B3 + b) & (2**64 - 1)
        found.append(0 if a == b else bucket(pair ^ (pair >> 29)))
    return {b: found.count(b) / len(found) for b in set(found)}


def plain_training(texts, labels):
    """Margin of the buckets that occur, and the bias, by gradient descent over dictionaries."""
    op = subword_quality
    rng = np.random.default_rng(op.SEED)
    start = rng.uniform(-1 / op.DIM, 1 / op.DIM, (1 << op.BUCKET_BITS, op.DIM))
    shares = [plain_features(t) for t in texts]
    vectors = {b: start[b].tolist() for s in shares for b in s}
    out, bias, step, total = [[0.0] * op.DIM, [0.0] * op.DIM], [0.0, 0.0], 0, op.EPOCHS * len(texts)
    for _ in range(op.EPOCHS):
        for i in rng.permutation(len(texts)):
            rate, step = op.RATE * (1 - step / total), step + 1
            mean = [sum(x * vectors[b][d] for b, x in shares[i].items()) for d in range(op.DIM)]
            logits = [sum(o * m for o, m in zip(out[c], mean, strict=True)) + bias[c] for c in (0, 1)]
            odds = [math.exp(x - max(logits)) for x in logits]
            error = [odds[c] / sum(odds) - (labels[i] == c) for c in (0, 1)]
            back = [error[0] * out[0][d] + error[1] * out[1][d] for d in range(op.DIM)]
            for b, x in shares[i].items():
                vectors[b] = [v - rate * x * len(shares[i]) ** 0.5 * g for v, g in zip(vectors[b], back, strict=True)]
            for c in (0, 1):
                out[c] = [o - rate * error[c] * m for o, m in zip(out[c], mean, strict=True)]
                bias[c] -= rate * 0.1 * error[c]
    return {b: sum(v * (p - q) for v, p, q in zip(vec, out[1], out[0], strict=True)) for b, vec in vectors.items()}, bias[1] - bias[0]


def test_training_and_scores_equal_a_plain_version(spark):
    good = ["the cat sat on the mat", "Les élèves étaient là, n'est-ce pas", "日本語の文章です 日本語", "it was not there but here", "a quiet day"]
    bad = ["ZAB ZAB ZAB ZAB", "!!! buy buy 🙂🙂🙂 now", "zab ЖЖЖЖ zab", "BUY !!! now !!!"]
    docs = [(i, t, "en", "s", 0, 1, "x") for i, t in enumerate([*good, *bad] * 3)] + [(500, "", "en", "s", 0, 1, "x")]
    labels = [(d[0], int(d[0] % 9 < 5), 0) for d in docs[:-1]]
    got = {r.doc_id: r.score for r in subword_quality.score_quality(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    learned = [(d[0], d[1]) for d in docs[:-1] if zlib.crc32(str(d[0]).encode()) % 3 != 1]
    margin, bias = plain_training([t for _, t in learned], [int(i % 9 < 5) for i, _ in learned])
    seen = {t for _, t in learned}
    assert len(seen) == len(good) + len(bad)
    for d in docs:
        value = sum(x * margin[b] for b, x in plain_features(d[1]).items()) if d[1] else 0.0
        assert abs(got[d[0]] - 1 / (1 + math.exp(-(value + bias)))) < 1e-3, d


def test_scoring_holds_little_besides_its_texts(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, "en", 400) for _ in range(1500)]
    model = {"margin": np.linspace(-1, 1, 1 << subword_quality.BUCKET_BITS).astype(np.float32), "bias": 0.1}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    scores = next(subword_quality.scorer(model)(iter([batch]))).column("score").to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # with slices of 1 MB it was more
    monkeypatch.setattr(subword_quality, "SLICE", 1 << 20)
    assert next(subword_quality.scorer(model)(iter([batch]))).column("score").to_pylist() == scores
    monkeypatch.setattr(subword_quality, "PASSED", 7)
    docs = documents(n=60)
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(docs) if r[0] is not None], "doc_id long, quality int, toxic int")
    good = [r.doc_id for r in subword_quality.score_quality(frame(spark, docs), labels).collect() if r.predicted]
    assert sorted(map(str, good)) == sorted(str(r.doc_id) for r in subword_quality.keep_good(frame(spark, docs), labels).collect())
