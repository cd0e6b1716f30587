"""SimHash near-duplicate classes by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into parts of correlated bits. For any thresholds t_i >= -1 that sum to
distance - parts + 1, two fingerprints within the distance differ in at most t_i bits in at least one part i, so probing
every part within its threshold finds every pair. Dynamic programming allots the thresholds by estimated cost; the number of
parts is the cheapest of those tried. Work is on distinct fingerprints, so exact copies never meet as pairs, and
each bucket returns a spanning forest of its verified links, not the links themselves.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; texts under the shingle width are one
shingle; rows with equal doc_id are separate rows that share a class with their equals; a null doc_id is carried, and a class
that has no other id gets null; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import lean, let, lower_ascii, materialize, row_key, row_slices, scratch_dir, temporary, unused, words

BITS = 64
#: Rows of a bucket that one task compares; larger buckets are cut into blocks and every pair of blocks is compared.
BLOCK = 4096
#: Relative costs of one bucket row and of one compared pair, for the allotment, and fingerprints whose pairs it is estimated from.
ROW_COST, PAIR_COST, SAMPLE = 100.0, 1.0, 1024
NO_SAMPLE = np.zeros(0, np.uint64)
#: Hashes that a task counts bits of at once.
HASH_SLICE = 1 << 17


def shingle_hashes(text, width: int):
    """XXH64 (seed 42) of every space-joined run of width words, repeats included."""
    ws = words(lower_ascii(text))
    return let(
        ws,
        lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " "))))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )


def _majority_bits(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each run of hashes the word whose bits are set in over half of them; zero for an empty run."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full, step = np.flatnonzero(n), 1 << 15
    counts = np.zeros((len(n), BITS), np.int64)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    for at in range(first, last, step):
        end = min(at + step, last)
        bits = np.unpackbits(values[at:end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(offsets[1:], at, side="right"))
        hi = int(np.searchsorted(offsets[:-1], end, side="left"))
        rows = np.arange(lo, hi)
        rows = rows[n[rows] > 0]
        starts = np.maximum(offsets[rows], at) - at
        counts[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    if len(full):
        ones = (2 * counts[full] > n[full, None]).astype(np.uint8)
        out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _remix(h: np.ndarray) -> np.ndarray:
    """A second hash of each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _in_slices(values: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of each run of hashes: one of the hashes, and one after each of words - 1 remixes of them; a slice of the runs at a time, so that
    a task holds little."""
    out = np.zeros((len(offsets) - 1, words), np.uint64)
    for lo, hi in row_slices(offsets, HASH_SLICE):
        at, h = offsets[lo : hi + 1] - offsets[lo], values[offsets[lo] : offsets[hi]]
        for k in range(words):
            h = _remix(h ^ np.uint64(k - 1)) if k else h
            out[lo:hi, k] = _majority_bits(h, at)
    return out


def majority(more: bool):
    """A mapInArrow function: hashes -> fp, other columns are carried; with more also n, the number of hashes, fp2, the fingerprint of the
    remixed hashes, and sketch, the SKETCH smallest hashes (unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            offsets, values = np.asarray(lists.offsets, dtype=np.int64), np.asarray(lists.values, dtype=np.int64).view(np.uint64)
            out = {c: batch.column(c) for c in batch.schema.names if c != "hashes"}
            found = _in_slices(values, offsets, 2 if more else 1)
            out["fp"] = pa.array(found[:, 0].view(np.int64))
            if more:
                out["n"] = pa.array(np.diff(offsets).astype(np.int32))
                out["fp2"] = pa.array(found[:, 1].view(np.int64))
                least = [np.partition(own, SKETCH - 1)[:SKETCH] if len(own) > SKETCH else own for own in map(values.__getitem__, map(slice, offsets[:-1], offsets[1:]))]
                out["sketch"] = pa.array([x.view(np.int64) for x in least], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and 64-bit SimHash (as a signed long) of every row of docs(doc_id, text)."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text"), width).alias("hashes"))
    return hashed.mapInArrow(lean(majority(False)), "doc_id long, fp long")


def _co_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.float64)
    for batch in batches:
        fps = np.asarray(batch.column("fp"), dtype=np.int64)
        for at in range(0, len(fps), 1 << 16):
            x = np.unpackbits(np.ascontiguousarray(fps[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
    cells = np.arange(BITS * BITS)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones of each bit and the bits' absolute correlations, over all of them."""
    rows = distinct.select("fp").mapInArrow(_co_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    co = np.zeros(BITS * BITS)
    for r in rows:  # one row for each pair of bits, whatever the input
        co[r["cell"]] = r["n"]
    co = co.reshape(BITS, BITS)
    n = distinct.count()
    p = np.diag(co) / max(n, 1)
    var = p * (1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs((co / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var)))
    corr = np.nan_to_num(corr)
    np.fill_diagonal(corr, 0)
    return n, p, corr


def correlated_parts(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each starts from the free bit most tied to the others and takes its closest bits."""
    free, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        order = sorted(free)
        part = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            order = sorted(free)
            part.append(max(order, key=lambda b: (corr[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def _within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that a random pair differs in at most 0, 1, ... most of the given bits, were they independent."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        shifted = np.concatenate([[0], dist[:-1]]) * q
        dist = dist * (1 - q) + shifted
    return np.cumsum(dist)


def pair_chances(p: np.ndarray, part: list[int], most: int, sample: np.ndarray) -> np.ndarray:
    """Chance that a pair differs in at most 0, 1, ... most bits of a part: the share among all pairs of the sampled
    fingerprints, which sees how the part's bits go together, or what independent bits give if that is more."""
    chance = _within(p[part], most)
    if len(sample) > 1:
        own = sample & np.uint64(sum(1 << b for b in part))
        seen = np.zeros(most + 1)
        for i in range(0, len(own), 256):
            seen += np.bincount(np.minimum(np.bitwise_count(own[i : i + 256, None] ^ own[None, :]).ravel(), most + 1), minlength=most + 2)[: most + 1]
        seen[0] -= len(own)  # pairs with itself
        chance = np.maximum(chance, np.cumsum(seen) / (len(own) * (len(own) - 1)))
    return np.minimum(chance, 1.0)


def allot(n: int, p: np.ndarray, parts: list[list[int]], distance: int, sample: np.ndarray = NO_SAMPLE, row_cost: float = ROW_COST) -> tuple[float, list[int]]:
    """Cheapest thresholds for the parts, summing to distance - parts + 1, by dynamic programming over the running sum."""
    need, most = distance - len(parts) + 1, distance
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        chance, step = pair_chances(p, part, most, sample), {}
        for t in range(-1, min(most, len(part) - 1) + 1):  # with a threshold of all its bits a part would tell nothing apart
            keys = 0.0 if t < 0 else 1 + sum(comb(len(part), k) / 2 for k in range(1, t + 1))
            cost = 0.0 if t < 0 else n * keys * row_cost + n * n / 2 * chance[t] * PAIR_COST
            for s, (c, ts) in best.items():
                if s + t not in step or step[s + t][0] > c + cost:
                    step[s + t] = (c + cost, [*ts, t])
        best = step
    return best.get(need, (inf, []))


def plan_parts(n: int, p: np.ndarray, corr: np.ndarray, distance: int, sample: np.ndarray = NO_SAMPLE, row_cost: float = ROW_COST) -> list[tuple[list[int], int]]:
    """Parts and thresholds of the cheapest plan among 2 to distance + 1 parts; parts with threshold -1 are left out."""
    plans = []
    for m in range(min(2, distance + 1), distance + 2):
        parts = correlated_parts(corr, m)
        cost, ts = allot(n, p, parts, distance, sample, row_cost)
        plans.append((cost, m, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def sampled_prints(distinct: DataFrame) -> np.ndarray:
    """At most SAMPLE fingerprints, the first by a hash: plans are estimated from their pairs, results don't depend on them."""
    rows = distinct.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(SAMPLE).collect()
    return np.array([r["fp"] for r in rows], np.int64).view(np.uint64)


def bucket_rows(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, probe, fp): each fingerprint under its own key of every part, and as a probe under the keys near it.
    Of the two directions of a flip only the one that raises the lowest flipped bit is emitted."""
    rows = []  # further columns of distinct are carried
    for number, (part, t) in enumerate(plan):
        key = F.lit(0).cast("long")
        for j, b in enumerate(part):
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), b).bitwiseAND(F.lit(1).cast("long")), j))
        masks = [sum(1 << j for j in flip) for k in range(1, t + 1) for flip in combinations(range(len(part)), k)]
        entries = F.array(F.struct(F.col("own").alias("key"), F.lit(0).alias("probe")))
        if masks:
            raised = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("own").bitwiseAND(m.bitwiseAND(-m)) == 0)
            entries = F.concat(entries, F.transform(raised, lambda m: F.struct(F.col("own").bitwiseXOR(m).alias("key"), F.lit(1).alias("probe"))))
        rows.append(distinct.withColumn("own", key).select(F.lit(number).alias("part"), *distinct.columns, F.explode(entries).alias("e")).select("part", "e.key", "e.probe", *distinct.columns))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; label holds every position's smallest known class mate, flattened."""
    while len(a):
        ra, rb = label[a], label[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _forest(start: np.ndarray, end: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the verified pairs of sorted buckets; end: where each row's bucket ends."""
    label = np.arange(len(fp))
    left = np.flatnonzero((probe == 0) & (start + 1 < end))
    shift = 1
    while len(left):
        right = left + shift
        near = np.bitwise_count(fp[left] ^ fp[right]) <= distance
        _join_labels(label, left[near], right[near])
        shift += 1
        left = left[left + shift < end[left]]
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied], fp[label[tied]]


def link_buckets(distance: int):
    """A mapInArrow function over rows sorted by bucket: returns links a > b between different fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end = np.repeat(np.r_[first[1:], len(fp)], np.diff(np.r_[first, len(fp)]))
            a, b = _forest(np.arange(len(fp)), end, probe, fp.view(np.uint64), distance)
            a, b = a.view(np.int64), b.view(np.int64)
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            keep = hi != lo
            return pa.RecordBatch.from_arrays([pa.array(hi[keep]), pa.array(lo[keep])], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("part", "key", "pair", "probe", "fp")]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            part, key, pair = held[:3]
            new = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            if len(new):
                cut = int(new[-1])
                bucket = np.zeros(cut, np.int64)
                bucket[new[:-1]] = 1
                yield links(np.cumsum(bucket), held[3][:cut], held[4][:cut])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield links(np.zeros(len(held[0]), np.int64), held[3], held[4])

    return run


def spread_hot(rows: DataFrame, block: int) -> DataFrame:
    """Adds pair: 0 in buckets up to block rows; larger buckets are dealt into blocks of half that size and each row goes to
    every pair of blocks that its own block is in, so that all pairs of the bucket still meet and no task holds the whole."""
    hot = materialize(rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "simhash-hot")
    k = F.ceil(F.col("n") / F.lit(block // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(j, mine) * F.col("k") + F.greatest(j, mine))
    joined = rows.join(hot.withColumn("k", k).drop("n"), ["part", "key"], "left")
    return joined.select(*rows.columns, F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges(a, b): root is the smallest vertex of its component. Alternates large-star and
    small-star steps, each of which only ties vertices to smaller neighbours, until the edges stop changing. The minima of large-star are
    written before they are joined, so that the join of a vertex with very many edges can be split."""
    own = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    seen = None
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m").select(F.col("s.x").alias("a"), F.col("m").alias("b"))
        own = materialize(small.where("a <> b").distinct(), "star")
        now = own.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen is not None and tuple(now) == tuple(seen):
            return own.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = now


def classes(prints: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for prints(doc_id, fp): component_id is the smallest doc_id reachable over links of
    distance bits or fewer, the row's own included."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    n, p, corr = bit_statistics(distinct)
    plan = plan_parts(max(n, 2), p, corr, distance, sampled_prints(distinct))  # with no rows every plan would cost nothing
    rows = spread_hot(bucket_rows(distinct.select("fp"), plan), block)
    dealt = rows.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair", "probe", "fp")
    roots = components(dealt.mapInArrow(lean(link_buckets(distance)), "a long, b long"))
    named = materialize(distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-named")
    lows = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    ids = materialize(named.join(lows, "root").select("fp", "component_id"), "simhash-ids")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text)."""
    found = classes(materialize(fingerprints(docs, width), "simhash"), distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The pipeline's near duplicates: words of a shingle, shingle Jaccard from which two texts are near copies, and the bits within
#: which a pair becomes a candidate: STAGE_DISTANCE of the 64 that are searched, STAGE_BOTH of these and the 64 remixed ones. README has the
#: share of pairs at 0.8 and above that these bits find.
STAGE_WIDTH, STAGE_JACCARD, STAGE_DISTANCE, STAGE_BOTH = 5, 0.8, 16, 31
#: Before that a text has to share SHARED of its SKETCH smallest shingle hashes with those of other texts, or STAGE_JACCARD of them if it has no more: the
#: smallest hashes of two texts together are in both with the chance of their Jaccard, so at 0.8 one text in 1,700 shares fewer.
SKETCH, SHARED = 12, 5
#: Texts that have a near one by these bits are compared by further remixed fingerprints: in the second round by MORE_WORDS of them, which may differ in
#: MORE_BITS, in the last one by LAST_WORDS and LAST_BITS. A pair of Jaccard 0.8 differs in 15.15 % of the bits on average.
MORE_WORDS, MORE_BITS, LAST_WORDS, LAST_BITS = 8, 95, 64, 680
#: Here a bucket row costs so many compared pairs; buckets are cut beyond STAGE_BLOCK rows; tiles have TILE pairs, and buckets of up to SMALL rows are
#: compared side by side. A task passes pairs on when it holds HELD_PAIRS, and looks at the further fingerprints of AT_ONCE pairs at a time.
STAGE_ROW_COST, STAGE_BLOCK, TILE, SMALL, HELD_PAIRS, AT_ONCE = 4000.0, 1 << 16, 1 << 16, 48, 1 << 15, 1 << 12
#: Bit of a bucket number from which on it names the part.
PART_AT = 40
#: Columns of a bucket row: bucket number with the lowest bit set for a probe, the pair of blocks, both fingerprints, the unit,
#: its number of shingles, its label and, once they are known, its further fingerprints.
BUCKET = ("bucket", "pair", "fp", "fp2", "unit", "n", "label", "more")


def near_in_buckets(cols: list[np.ndarray], distance: int, both: int, jaccard: float, plan: list[tuple[list[int], int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by bucket, probes last: positions of pairs of different units in one bucket, at least one of them no
    probe, within the distances and with sizes that allow the Jaccard; and their distance. With the plan, pairs that also meet in a bucket of an earlier part
    are left to it."""
    masks = [(np.uint64(sum(1 << b for b in part)), t) for part, t in plan or ()]
    bucket, pair, fp, fp2, unit, n, _, more = cols
    key = bucket >> 1
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    last = np.r_[first[1:], len(fp)]
    own = np.add.reduceat(1 - (bucket & 1), first)  # rows that are no probes
    fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)

    def passed(l: np.ndarray, r: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        off = off + np.bitwise_count(fp2[l] ^ fp2[r])
        good = (off <= both) & (unit[l] != unit[r]) & (np.minimum(n[l], n[r]) >= jaccard * np.maximum(n[l], n[r]) - 1e-9)
        l, r, off = l[good], r[good], off[good]
        if masks and len(l):
            differ, own_part, first_here = fp[l] ^ fp[r], bucket[l] >> PART_AT, np.ones(len(l), bool)
            for number, (mask, t) in enumerate(masks[:-1]):
                first_here &= (own_part <= number) | (np.bitwise_count(differ & mask) > t)
            l, r, off = l[first_here], r[first_here], off[first_here]
        if more.shape[1]:
            apart = np.zeros(len(l), np.int64)
            for at in range(0, len(l), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                apart[some] = np.bitwise_count(more[l[some]] ^ more[r[some]]).sum(axis=1, dtype=np.int64)
            near = apart <= (MORE_BITS if more.shape[1] == MORE_WORDS else LAST_BITS)
            l, r, off = l[near], r[near], apart[near]
        return l, r, off

    small = last - first <= SMALL
    end = np.repeat(last, last - first)
    left, shift = np.flatnonzero(np.repeat(small, last - first) & (bucket & 1 == 0) & (np.arange(len(fp)) + 1 < end)), 1
    while len(left):
        off = np.bitwise_count(fp[left] ^ fp[left + shift])
        near = np.flatnonzero(off <= distance)
        if len(near):
            yield passed(left[near], left[near] + shift, off[near].astype(np.int64))
        shift += 1
        left = left[left + shift < end[left]]
    for a, b, k in zip(first[~small], last[~small], own[~small], strict=True):
        step = max(1, TILE // int(b - a))
        for at in range(int(a), int(a + k), step):
            to = min(at + step, int(a + k))
            off = np.bitwise_count(fp[at:to, None] ^ fp[None, at:b])
            near = np.flatnonzero(off <= distance)
            if len(near):
                yield passed(at + near // (int(b) - at), at + near % (int(b) - at), off.ravel()[near].astype(np.int64))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by bucket, cut where a bucket ends."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(batch.column(c)) for c in BUCKET[:-1]]
        wide = batch.column("more").to_pylist() if "more" in batch.schema.names else []
        cols.append(np.frombuffer(b"".join(wide), np.uint64).reshape(batch.num_rows, -1) if wide else np.zeros((batch.num_rows, 0), np.uint64))
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key, pair = held[0] >> 1, held[1]
        new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        if len(new):
            yield [x[: new[-1]] for x in held]
            held = [x[new[-1] :] for x in held]
    if held is not None and len(held[0]):
        yield held


def nearest_mates(distance: int, both: int, jaccard: float, across: bool):
    """A mapInArrow function over sorted bucket rows -> (unit, off, mate): of every unit with a near one its nearest smaller unit,
    or null if there is none; with across, its nearest unit of another label, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_buckets(batches):
            unit, label = cols[4], cols[6]
            best, mate, paired = np.full(len(unit), 1 << 20), np.zeros(len(unit), np.int64), np.zeros(len(unit), bool)
            for l, r, off in near_in_buckets(cols, distance, both, jaccard):
                if across:
                    apart = label[l] != label[r]
                    own, other, off = np.r_[l[apart], r[apart]], np.r_[r[apart], l[apart]], np.r_[off[apart], off[apart]]
                else:
                    own, other = np.where(unit[l] > unit[r], l, r), np.where(unit[l] > unit[r], r, l)
                    paired[other] = True
                order = np.lexsort((unit[other], off, own))
                head = order[np.flatnonzero(np.diff(own[order], prepend=-1))]
                closer = head[off[head] < best[own[head]]]
                best[own[closer]], mate[own[closer]] = off[closer], unit[other[closer]]
            rows = np.flatnonzero(paired | (best < 1 << 20))
            if len(rows):
                some = best[rows] < 1 << 20
                yield pa.RecordBatch.from_arrays([pa.array(unit[rows]), pa.array(best[rows]), pa.array(mate[rows], mask=~some)], names=["unit", "off", "mate"])

    return run


def open_pairs(distance: int, both: int, jaccard: float, plan: list[tuple[list[int], int]]):
    """A mapInArrow function over sorted bucket rows -> pairs a > b of near units with different labels, and these; each pair from one of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], names=["a", "b", "label_a", "label_b"])

        held, count = [], 0
        for cols in _whole_buckets(batches):
            unit, label = cols[4], cols[6]
            for l, r, _ in near_in_buckets(cols, distance, both, jaccard, plan):
                apart = label[l] != label[r]
                l, r = l[apart], r[apart]
                a, b = np.where(unit[l] > unit[r], l, r), np.where(unit[l] > unit[r], r, l)
                held.append(np.stack([unit[a], unit[b], label[a], label[b]], axis=1))
                count += len(a)
                if count > HELD_PAIRS:
                    yield out(held)
                    held, count = [], 0
        if count:
            yield out(held)

    return run


def more_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, s) -> (unit, more): LAST_WORDS fingerprints of the hashes, after those of majority."""
    for batch in batches:
        lists = batch.column("s")
        wide = _in_slices(np.asarray(lists.values, dtype=np.int64).view(np.uint64), np.asarray(lists.offsets, dtype=np.int64), 2 + LAST_WORDS)[:, 2:]
        yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array([w.tobytes() for w in wide], pa.binary())], names=["unit", "more"])


def sorted_buckets(units: DataFrame, plan: list[tuple[list[int], int]], block: int) -> DataFrame:
    """BUCKET rows of units(fp, fp2, unit, n, label, perhaps more), dealt out and sorted by bucket: each unit under its own key of every part,
    and as a probe under the keys near it. Of the two directions of a flip only the one that raises the lowest flipped bit is made."""

    def bits(part: list[int]):
        key = F.lit(0).cast("long")
        for j, b in enumerate(part):
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), b).bitwiseAND(F.lit(1).cast("long")), j))
        return key

    def entries(number: int, part: list[int], t: int) -> list:
        own, base = F.col(f"key{number}"), F.lit(number << PART_AT).cast("long")
        masks = [sum(1 << j for j in flip) for k in range(1, t + 1) for flip in combinations(range(len(part)), k)]
        raised = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: own.bitwiseAND(m.bitwiseAND(-m)) == 0)
        probes = F.transform(raised, lambda m: base + F.shiftleft(own.bitwiseXOR(m), 1) + F.lit(1))
        return [F.array(base + F.shiftleft(own, 1)), *([probes] if masks else [])]

    keyed = units.select("*", *[bits(part).alias(f"key{number}") for number, (part, _) in enumerate(plan)])
    every = [e for number, (part, t) in enumerate(plan) for e in entries(number, part, t)]
    carried = [c for c in BUCKET[2:] if c in units.columns]
    rows = keyed.select(F.explode(F.concat(*every)).alias("bucket"), *carried)
    key = F.shiftright("bucket", 1)
    hot = materialize(rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block), "near-hot")
    cut = hot.select("key", F.ceil(F.col("rows") / F.lit(block // 2)).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("unit"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(j, mine) * F.col("k") + F.greatest(j, mine))
    joined = rows.withColumn("key", key).join(cut, "key", "left")
    dealt = joined.select("bucket", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("pair"), *carried)
    return dealt.repartition(F.shiftright("bucket", 1), "pair").sortWithinPartitions("pair", "bucket")


def with_shared_sketch(units: DataFrame, jaccard: float) -> DataFrame:
    """The units(unit, n, sketch, ...) whose sketch shares enough hashes with the sketches of others, without sketch."""
    rows = units.select("unit", F.explode("sketch").alias("h"))
    several = rows.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h")
    shares = rows.join(several.hint("shuffle_hash"), "h", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("shared"))
    need = F.when(F.col("n") > SKETCH, F.lit(float(SHARED))).otherwise(F.lit(jaccard) * F.col("n") - F.lit(1e-9))
    return units.join(shares.hint("shuffle_hash"), "unit").where(F.col("shared") >= need).drop("sketch", "shared")


def near_copies(docs: DataFrame, width: int, jaccard: float, distance: int, both: int, block: int = STAGE_BLOCK) -> DataFrame:
    """id, row_key, copies, root for the different rows of docs: root names the class of texts that are tied by shingle Jaccard
    of jaccard or more, where the pairs looked at are those within the distances. A unit is a text in lower case without
    regard to white space. Units that share too few of their smallest hashes with others have no near copy and are classes of their own. First each unit's nearest smaller one is found, whose verified links tie dense groups without all
    their pairs. Units that have a near one get further fingerprints; then each looks for its nearest one of another class, and last every
    pair that is still of two classes and near by all fingerprints is verified. Links of the last step tie classes, not texts."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), row_key(docs).alias("row_key"), words(lower_ascii(F.col("text"))).alias("w"), "text")
    hashed = keyed.select("id", "row_key", F.xxhash64(F.array_join("w", " ")).alias("unit"), F.array_distinct(shingle_hashes(F.col("text"), width)).alias("hashes"))
    prints = materialize(hashed.mapInArrow(lean(majority(True)), "id long, row_key long, unit long, fp long, n int, fp2 long, sketch array<long>"), "near-prints")
    rows = materialize(prints.groupBy("id", "row_key", "unit").agg(F.count(F.lit(1)).alias("copies")), "near-rows")
    every = materialize(prints.groupBy("unit").agg(*[F.first(c).alias(c) for c in ("fp", "fp2", "n", "sketch")], F.min("row_key").alias("row_key")), "near-every")  # rows of a unit differ in row_key only
    units = materialize(with_shared_sketch(every, jaccard), "near-units")
    n, p, corr = bit_statistics(units)
    sample = sampled_prints(units)
    plan = plan_parts(max(n, 2), p, corr, distance, sample, STAGE_ROW_COST)

    def mates(rows: DataFrame, across: bool, plan: list[tuple[list[int], int]]) -> DataFrame:
        found = sorted_buckets(rows, plan, block).mapInArrow(lean(nearest_mates(distance, both, jaccard, across)), "unit long, off long, mate long")
        nearest = F.min(F.when(F.col("mate").isNotNull(), F.struct("off", "mate")))
        return materialize(found.groupBy("unit").agg(nearest["mate"].alias("mate")), "near-paired")

    paired = mates(units.withColumn("label", F.col("unit")), False, plan)
    near_units = materialize(units.join(paired.select("unit"), "unit", "left_semi"), "near-some")
    fewer = plan_parts(max(near_units.count(), 2), p, corr, distance, sample, STAGE_ROW_COST)  # for the texts that are still compared
    wanted = near_units.select("unit", "row_key").hint("shuffle_hash")  # alike at every size
    texts = docs.select(row_key(docs).alias("row_key"), "text").join(wanted, "row_key").select("unit", F.array_distinct(shingle_hashes(F.col("text"), width)).alias("s"))
    sets = materialize(texts.dropDuplicates(["unit"]), "near-shingles")
    more = materialize(sets.mapInArrow(lean(more_prints), "unit long, more binary"), "near-more")

    def verified(found: DataFrame) -> DataFrame:
        """Those of found(a, b and others) whose texts have the Jaccard, without a and b if there are others."""
        kept = [c for c in found.columns if c not in ("a", "b")] or ["a", "b"]
        needed = materialize(found.select(F.explode(F.array("a", "b")).alias("unit")).distinct(), "near-needed")
        some = sets.join(needed, "unit", "left_semi")
        both_sets = found.join(some.select(F.col("unit").alias("a"), F.col("s").alias("sa")), "a").join(some.select(F.col("unit").alias("b"), F.col("s").alias("sb")), "b")
        common = both_sets.select(*kept, F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
        return materialize(common.where(F.col("common") >= F.lit(jaccard) * (F.col("sizes") - F.col("common")) - F.lit(1e-9)).select(*kept).distinct(), "near-links")

    def labelled(links: DataFrame, words_: int) -> DataFrame:
        roots = components(links)
        named = near_units.join(roots, F.col("unit") == F.col("v"), "left").join(more, "unit")
        return materialize(named.select("fp", "fp2", "unit", "n", F.substring("more", 1, 8 * words_).alias("more"), F.coalesce("root", "unit").alias("label")), "near-labels")

    def as_pairs(found: DataFrame) -> DataFrame:
        return found.where("mate is not null").select(F.greatest("unit", "mate").alias("a"), F.least("unit", "mate").alias("b")).distinct()

    near = verified(as_pairs(paired))
    near = near.unionByName(verified(as_pairs(mates(labelled(near, MORE_WORDS), True, fewer))))
    classes_ = labelled(near, LAST_WORDS)
    pairs = sorted_buckets(classes_, fewer, block).mapInArrow(lean(open_pairs(distance, both, jaccard, fewer)), "a long, b long, label_a long, label_b long").distinct()
    tied = verified(materialize(pairs, "near-pairs"))
    over = components(tied.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    named = materialize(classes_.select("unit", "label").join(over, F.col("label") == F.col("v"), "left").select("unit", F.coalesce("root", "label").alias("root")), "near-classes")
    return rows.join(named, "unit", "left").select("id", "row_key", "copies", F.coalesce("root", "unit").alias("root"))


def keep_one_of_each(docs: DataFrame, width: int = STAGE_WIDTH, jaccard: float = STAGE_JACCARD, distance: int = STAGE_DISTANCE, both: int = STAGE_BOTH) -> DataFrame:
    """Of every class of near copies one row: that with the smallest doc_id (none last), then the smallest hash of the row.
    Rows that share a doc_id, or have none, are rows like any other; texts without a word are copies of each other. Columns are
    those of docs."""
    path = f"{scratch_dir(docs.sparkSession)}/near-judged-{uuid.uuid4().hex}"
    with temporary(docs.sparkSession):
        found = materialize(near_copies(docs, width, jaccard, distance, both), "near-rows-of-classes")
        place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row_key"))
        first = materialize(found.groupBy(F.col("root").alias("class")).agg(F.min(place).alias("first")), "near-firsts")
        stays = F.col("row_key") == F.col("first.row_key")
        found.join(first, found["root"] == first["class"]).select("row_key", "copies", stays.alias("stays")).write.parquet(path)
    judged = docs.sparkSession.read.schema("row_key long, copies long, stays boolean").parquet(path)
    key = unused("near_key", docs.columns)
    own = docs.withColumn(key, row_key(docs))

    def pick(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return df.join(keys.select(F.col("row_key").alias(key)).hint("shuffle_hash"), key, how)  # alike at every size

    kept = pick(own, judged.where("not stays"), "left_anti")
    repeated = judged.where("stays and copies > 1")  # equal rows in every column
    if not repeated.isEmpty():
        kept = pick(kept, repeated, "left_anti").unionByName(pick(kept, repeated, "left_semi").dropDuplicates([key]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
