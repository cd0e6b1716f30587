import hashlib
import random
import re
import time
import zlib

import numpy as np

from inkstone.llm import periodic_runs as op
from tests.llm.fixtures import documents, frame


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def with_planted_runs(rng, n, words):
    w = [rng.randrange(words) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, e = rng.randrange(n), rng.randint(0, n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        for i in range(a, e):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_and_counts_equal_brute_force():
    rng = random.Random(11)
    found = 0
    for _ in range(1200):
        w = with_planted_runs(rng, rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5, 40]))
        got = op.runs_of(np.array(w, np.int64))
        assert got == brute_runs(w), w
        found += len(got)
        if len(w) > 4:
            most = len(w) // 4
            assert op.lag_counts(np.array(w, np.int64), most).tolist() == [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(most + 1)]
    assert found > 500
    for words in (1, 2, 4):  # counts of frequent words come from the transform
        w = np.array([rng.randrange(words) for _ in range(3000)], np.int64)
        assert op.lag_counts(w, 750).tolist() == [int((w[q:] == w[: len(w) - q]).sum()) for q in range(751)]


def test_long_texts_of_few_words_end_soon():
    started = time.time()
    for w in (np.zeros(10**6, np.int64), np.arange(10**6) % 3, np.tile(np.arange(1000), 300), np.random.default_rng(1).integers(0, 2, 10**5)):
        runs = op.runs_of(w)
        assert runs and all(length >= max(6, 4 * q) for _, length, q in runs)
    assert time.time() - started < 60
    assert op.runs_of(np.tile(np.arange(1000), 300)) == [(0, 300000, 1000)]


def brute(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force_on_awkward_tables(spark):
    rng = random.Random(5)
    docs = [d for d in documents() if d[0] != 2004]  # the long text is too slow for the plain version
    docs += [(4000 + k, " ".join(f"w{x}é" for x in with_planted_runs(rng, rng.randint(5, 90), rng.choice([1, 2, 3, 30]))) + " \n", "en", "s", 0, 7, "x") for k in range(150)]
    docs += [docs[-1], (None, "a a a a a a", "en", "s", 0, 7, "x"), (-7, "x y x y x y x y x y", None, None, 0, 7, "x")]
    got = op.digest(op.find_runs(op.with_repeats(frame(spark, docs)))).collect()
    have = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got]
    assert sorted(map(repr, have)) == sorted(repr(brute(d[0], d[1])) for d in docs)
    assert sum(r.n_runs > 0 for r in got) > 30 and any(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs)
    assert op.digest(op.find_runs(op.with_repeats(frame(spark, [])))).count() == 0
