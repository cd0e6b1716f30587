"""Quality classifier: hashed word and character n-gram vectors, averaged for each document, with a softmax output.

The vectors and the output layer are trained by plain stochastic gradient descent in numpy on a bounded sample of the labelled
training rows (SAMPLE per class, the first by a hash of the id; whole texts). As the output is linear in the mean vector, each
bucket's share of the margin is known after training, and tasks add those shares over every character of every text.

Defined cases: null and empty texts have no feature and score by the output bias alone; ids may repeat, each row is scored;
labels that are null or not 0/1 are not learned from; without labels of both classes every score is the share of label 1
(0.5 without labels); an empty table gives an empty result; extra columns are ignored here and kept by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import doc_crc32, lean, row_slices, text_buffers

#: Labelled rows of each class that training may read.
SAMPLE = 1500
BUCKET_BITS, DIM, EPOCHS, RATE, SEED = 17, 16, 4, 2.0, 7
GRAMS = (3, 4, 5)
#: Bytes of texts that a task scores at once, which it needs many times over and Python's workers keep; features of one array in training; rows that
#: keep_good passes on at once.
SLICE, PACK, PASSED = 1 << 18, 1 << 22, 1000
_P32, _P64 = np.uint32(0x01000193), np.uint64(0x100000001B3)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes as numbers, and the offsets of the texts in them."""
    if not len(raw) or int(raw.max()) < 0x80:
        return raw.astype(np.uint32), offsets
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[first].astype(np.uint32)
    points = np.where(lead < 0x80, lead, np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07)))
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        longer = lead >= least
        points[longer] = (points[longer] << np.uint32(6)) | (raw[np.minimum(first[longer] + k, len(raw) - 1)] & np.uint32(0x3F))
    return points, np.searchsorted(first, offsets)


def _spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _bucket32(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def gram_features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: bucket of the gram that starts at each character, and a mask of grams inside one text."""
    wide = raw.astype(np.uint32, copy=False)
    ends = offsets[1:]
    h = np.full(len(raw), 0x811C9DC5, np.uint32)
    done = 0
    for n in GRAMS:
        while done < n:
            m = len(raw) - done
            if m > 0:
                h[:m] = h[:m] * _P32 + wide[done:] + np.uint32(1)
            done += 1
        inside = np.ones(len(raw), bool)
        for back in range(1, n):
            at = ends - back
            inside[at[at >= offsets[:-1]]] = False
        yield _bucket32(h), inside


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and bucket of every word and of every pair of neighbours; a word next to itself has one bucket of its own."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    space = _spaces(raw)
    fresh = np.r_[True, space[:-1]]
    inner = offsets[:-1]
    fresh[inner[inner < len(raw)]] = True
    starts = np.flatnonzero(fresh & ~space)
    if not len(starts):
        return starts, np.zeros(0, np.uint32)
    begin = np.zeros(len(raw), np.int64)
    begin[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(begin)
    place[space] = 0
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), _P64)], dtype=np.uint64)
    value = np.where(space, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * powers[place])
    h = np.add.reduceat(value, starts)
    single = _bucket32((h ^ (h >> np.uint64(32))).astype(np.uint32))
    pair = h[:-1] * _P64 + h[1:]
    pair = np.where(h[1:] == h[:-1], np.uint32(0), _bucket32((pair ^ (pair >> np.uint64(29))).astype(np.uint32)))
    owner = np.searchsorted(offsets, starts, side="right")
    inside = owner[1:] == owner[:-1]
    return np.r_[starts, starts[1:][inside]], np.r_[single, pair[inside]]


def sparse_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares, which sum to 1."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.array([0, len(raw)], np.int64)
    found = [b[inside] for b, inside in gram_features(raw, offsets)] + [word_features(raw, offsets)[1]]
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def packed_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """sparse_features of all texts, laid out in few large arrays, which give their memory back after training."""
    rows, ids, shares, at = [], np.empty(0, np.uint32), np.empty(0, np.float32), 0
    for text in texts:
        own, share = sparse_features(text)
        if at + len(own) > len(ids):
            ids, shares, at = np.empty(max(PACK, len(own)), np.uint32), np.empty(max(PACK, len(own)), np.float32), 0
        ids[at : at + len(own)], shares[at : at + len(own)] = own, share
        rows.append((ids[at : at + len(own)], shares[at : at + len(own)]))
        at += len(own)
    return rows


def train(texts: list[str], labels: list[int]) -> dict:
    """Learned margin of every bucket and the bias. One pass of a text updates its own buckets' vectors and the output layer."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    rows = packed_features(texts)
    steps, total = 0, max(1, EPOCHS * len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            grad = p / p.sum()
            grad[labels[i]] -= 1
            if len(ids):
                vectors[ids] -= rate * np.outer(share * np.float32(len(ids)) ** 0.5, grad @ out)
            out -= rate * np.outer(grad, mean)
            bias -= rate * np.float32(0.1) * grad
    return {"margin": (vectors @ (out[1] - out[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Train on labelled rows whose crc32(doc_id) mod 3 is not 1, at most sample of each class; texts come from docs."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(doc_crc32(F.col("doc_id")) % 3 != 1)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    usable = usable.distinct().join(known, "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    chosen = usable.where("quality = 0").orderBy("order", "doc_id").limit(sample).unionByName(usable.where("quality = 1").orderBy("order", "doc_id").limit(sample))
    ids = {(r["doc_id"], r["quality"]) for r in chosen.collect()}  # 2 * sample rows at most
    if len({q for _, q in ids}) < 2:
        counts = [sum(q == c for _, q in ids) for c in (0, 1)]
        share = counts[1] / sum(counts) if ids else 0.5
        return {"constant": share}
    picked = docs.sparkSession.createDataFrame(sorted(ids), "doc_id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["quality"], r["text"]) for r in texts.collect())
    return train([r[2] for r in rows], [r[1] for r in rows])


def scorer(model: dict):
    """A mapInArrow function (doc_id, text) -> (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            scores = np.full(len(offsets) - 1, model.get("constant", 0.5))
            for lo, hi in row_slices(offsets, SLICE) if "margin" in model else ():
                part, at = code_points(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total, count = np.zeros(hi - lo), np.zeros(hi - lo)
                full = np.flatnonzero(np.diff(at))
                for bucket, inside in gram_features(part, at):
                    if len(full):
                        value = np.where(inside, model["margin"][bucket], np.float32(0))
                        total[full] += np.add.reduceat(value, at[:-1][full], dtype=np.float64)
                        count[full] += np.add.reduceat(inside, at[:-1][full], dtype=np.int64)
                starts, bucket = word_features(part, at)
                owner = np.searchsorted(at, starts, side="right") - 1
                total += np.bincount(owner, model["margin"][bucket], hi - lo)
                count += np.bincount(owner, minlength=hi - lo)
                scores[lo:hi] = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model["bias"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(lean(scorer(model)), "doc_id long, score double")
    return scored.select("doc_id", (doc_crc32(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose own text scores 0.5 or more, with the columns of docs."""
    model, columns = fit(docs, labels, sample), docs.columns
    score_of = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(columns.index("text"))
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], names=["doc_id", "text"])
            score = next(score_of(iter([plain]))).column("score")
            good = pa.array(np.asarray(score) >= 0.5)
            for at in range(0, batch.num_rows, PASSED):
                yield batch.slice(at, PASSED).filter(good.slice(at, PASSED))

    return docs.mapInArrow(lean(run), docs.schema)
