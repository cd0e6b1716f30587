import itertools
import random
import re
from collections import Counter

import numpy as np
import xxhash

from inkstone.llm import simhash_gph as op
from tests.llm.fixtures import documents, frame


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    runs = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_whole_operator_equals_brute_force(spark):
    rows = documents()
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in op.near_duplicates(frame(spark)).collect())
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_classes(prints, 4)
    low = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            low[root] = min(low.get(root, r[0]), r[0])
    assert got == sorted((str(r[0]), f"{p:016x}", low.get(root)) for r, p, root in zip(rows, prints, roots, strict=True))


def test_links_in_dense_groups_and_hot_buckets_are_all_found(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    for distance in (0, 2, 4):
        got = {r.doc_id: r.component_id for r in op.classes(df, distance, block=16).collect()}
        assert [got[i] for i in range(len(prints))] == brute_classes(prints, distance)


def test_every_allotment_meets_the_pigeonhole_sum():
    rng = np.random.default_rng(3)
    p, corr = rng.random(64), rng.random((64, 64))
    corr = (corr + corr.T) / 2
    np.fill_diagonal(corr, 0)
    for m in range(2, 6):
        parts = op.correlated_parts(corr, m)
        assert sorted(b for part in parts for b in part) == list(range(64))
        _, ts = op.allot(10**6, p, parts, 4)
        assert sum(ts) == 4 - m + 1
    # biased bits carry little: their part gets no probe while an even one is searched wider
    p = np.where(np.arange(64) < 32, 0.001, 0.5)
    corr = np.kron(np.eye(2), np.ones((32, 32))) - np.eye(64)
    parts = op.correlated_parts(corr, 2)
    ts = dict(zip([min(x) >= 32 for x in parts], op.allot(10**4, p, parts, 4)[1], strict=True))
    assert ts[True] > ts[False]


def test_empty_table(spark):
    assert op.near_duplicates(frame(spark, [])).count() == 0


def shingle_set(text, width=5):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set())


def stage_prints(shingles):
    """All fingerprints of a set of shingles, bit by bit."""
    hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    last = np.array(hs, np.uint64)
    rounds = [hs]
    for k in range(1 + op.LAST_WORDS):
        last = op._remix(last ^ np.uint64(k))
        rounds.append([int(h) for h in last])
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each)) for each in rounds]


def unit_of(text):
    return tuple(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w)


def sharing(texts):
    """Which texts share enough of their smallest shingle hashes with other texts."""
    units = list(map(unit_of, texts))
    least = {u: sorted(xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingle_set(" ".join(u)))[: op.SKETCH] for u in units}
    held = Counter(h for hs in least.values() for h in hs)
    return [sum(held[h] > 1 for h in least[u]) >= (op.SHARED if len(shingle_set(" ".join(u))) > op.SKETCH else 0.8 * len(least[u])) for u in units]


def jaccard_classes(texts, jaccard=0.8, within_bits=False):
    """The smallest position of each text's class, over all pairs; within_bits: only those that the stage's filters let through."""
    sets = [shingle_set(t) for t in texts]
    shares = sharing(texts)
    prints = [stage_prints(s) for s in sets] if within_bits else None
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= jaccard * len(sets[i] | sets[j]):
                if within_bits and unit_of(texts[i]) != unit_of(texts[j]):
                    if not (shares[i] and shares[j]):
                        continue
                    off = [(a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)]
                    if off[0] > op.STAGE_DISTANCE or off[0] + off[1] > op.STAGE_BOTH or sum(off[2:]) > op.LAST_BITS:
                        continue
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_each_open_pair_comes_from_one_bucket():
    rng = np.random.default_rng(5)
    plan = [(list(range(0, 20)), 2), (list(range(20, 41)), 1), (list(range(41, 64)), 1)]
    fp = rng.integers(0, 2**63, 6, dtype=np.int64)[rng.integers(0, 6, 80)] ^ (1 << rng.integers(0, 62, 80)) ^ (1 << rng.integers(0, 62, 80)) ^ (1 << rng.integers(0, 62, 80))
    rows = []
    for unit, f in enumerate(fp.tolist()):
        for number, (part, t) in enumerate(plan):
            own = sum((f >> b & 1) << j for j, b in enumerate(part))
            rows.append((number << op.PART_AT | own << 1, unit))
            for k in range(1, t + 1):
                for flip in itertools.combinations(range(len(part)), k):
                    if not own >> min(flip) & 1:
                        rows.append((number << op.PART_AT | (own ^ sum(1 << j for j in flip)) << 1 | 1, unit))
    rows.sort()
    bucket, unit = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    cols = [bucket, np.zeros(len(rows), np.int32), fp[unit], fp[unit] >> 1, unit, np.full(len(rows), 9, np.int32), unit, np.zeros((len(rows), 0), np.uint64)]
    found = [tuple(sorted(p)) for l, r, _ in op.near_in_buckets(cols, 6, 12, 0.8, plan) for p in zip(unit[l].tolist(), unit[r].tolist(), strict=True)]
    assert len(found) == len(set(found)) > 100
    every = {tuple(sorted(p)) for l, r, _ in op.near_in_buckets(cols, 6, 12, 0.8) for p in zip(unit[l].tolist(), unit[r].tolist(), strict=True)}
    assert set(found) == every


def test_near_pairs_of_buckets_equal_brute_force():
    rng = np.random.default_rng(4)
    for small in (0, 4, 1000):  # tiles only, both, side by side only
        op.SMALL, op.TILE = small, 64
        k = 90
        bucket = np.sort(rng.integers(0, 6, k) * 2 + rng.integers(0, 2, k)).astype(np.int64)
        centre = rng.integers(0, 2**63, 6, dtype=np.int64)
        fp = centre[bucket >> 1] ^ (1 << rng.integers(0, 62, k)) ^ (1 << rng.integers(0, 62, k))
        unit = rng.integers(0, 60, k)
        cols = [bucket, np.zeros(k, np.int32), fp, fp >> 1, unit, rng.integers(8, 12, k).astype(np.int32), unit, np.zeros((k, 0), np.uint64)]
        got = {(min(a, b), max(a, b)) for l, r, _ in op.near_in_buckets(cols, 3, 6, 0.8) for a, b in zip(l.tolist(), r.tolist(), strict=True)}
        bits = lambda x: int(x & (2**64 - 1)).bit_count()
        want = set()
        for i in range(k):
            for j in range(i + 1, k):
                d = bits(int(fp[i]) ^ int(fp[j]))
                if bucket[i] >> 1 == bucket[j] >> 1 and bucket[i] & 1 == 0 and unit[i] != unit[j] and d <= 3 and d + bits(int(fp[i] >> 1) ^ int(fp[j] >> 1)) <= 6 and min(cols[5][i], cols[5][j]) >= 0.8 * max(cols[5][i], cols[5][j]):
                    want.add((i, j))
        assert got == want and want
    op.SMALL, op.TILE = 48, 1 << 18


def test_estimated_pairs_are_near_the_counted_ones():
    rng = np.random.default_rng(6)
    topics = rng.integers(0, 2**63, 8, dtype=np.uint64)
    noise = np.bitwise_and.reduce(rng.integers(0, 2**63, (3, 6000), dtype=np.uint64))
    prints = topics[rng.integers(0, 8, 6000)] ^ noise  # bits that go together by topic
    bits = (prints[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    p = bits.mean(axis=0)
    corr = np.nan_to_num(np.abs(np.corrcoef(bits.T + rng.normal(0, 1e-9, (64, 6000)))))
    np.fill_diagonal(corr, 0)
    for part in op.correlated_parts(corr, 4):
        chance = op.pair_chances(p, part, 3, prints[:1024])
        own = prints & np.uint64(sum(1 << b for b in part))
        off = np.bitwise_count(own[:, None] ^ own[None, :])
        for t in range(4):
            counted = ((off <= t).sum() - len(own)) / (len(own) * (len(own) - 1))
            assert counted / 2 <= chance[t] <= 2 * counted


def test_stage_keeps_one_row_of_each_class_by_brute_force_jaccard(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for k in range(4):  # one or two changed places: Jaccard of about 0.83 to 0.92 with the base
            ws = list(base)
            for p in rng.sample(range(10, 110), min(k, 2)):
                ws[p] = f"x{rng.randrange(10**6)}"
            rows.append((None if k == 3 else 5 if k == 2 else 10 * g + k, " ".join(ws), "en", "s", 1, 7, "x"))
    rows += [rows[0], (None, None, "en", "s", 0, 7, "x"), (1, " ", "en", "s", 0, 7, "x"), (5, "quite another text under the same id", "en", "s", 0, 7, "x")]
    root = jaccard_classes([r[1] for r in rows])
    kept = op.keep_one_of_each(frame(spark, rows)).collect()
    classes = [root[next(i for i, r in enumerate(rows) if r == tuple(k))] for k in kept]
    assert sorted(classes) == sorted(set(root))
    for k, c in zip(kept, classes, strict=True):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None]
        assert k.doc_id == (min(ids) if ids else None)
    assert op.keep_one_of_each(frame(spark, [])).count() == 0


def test_stage_keeps_columns_with_the_names_of_working_columns(spark):
    names = ["near_key", "row_key", "unit", "fp2", "bucket", "pair", "copies", "stays", "w", "hashes", "a.b"]
    df = frame(spark)
    wide = df.select("*", *[df["lang"].alias(n) for n in names])
    assert op.keep_one_of_each(wide).columns == wide.columns
    assert op.keep_one_of_each(wide).count() == op.keep_one_of_each(df).count() == len(set(jaccard_classes([r[1] for r in documents()], within_bits=True)))
