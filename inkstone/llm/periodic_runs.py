"""Periodic runs of words: lag counting heavy and light, then island scans of the lags that can hold a run.

The number of equal words q apart is counted exactly for every lag q: pairs of words that occur often come from one FFT autocorrelation
of each word's places, pairs of rare words from the differences of their places. A run of period q and length l has l - q such
pairs in a row, an island; so a lag with fewer pairs than the shortest run needs is never looked at. Pairs that lie in a run already found with a
period that divides q are taken off first: two runs of different smallest period q and d share fewer than q + d - gcd(q, d) words, so a
new run has no such pair. An island of 3q pairs holds three places divisible by q, hence long lags are looked at in steps of q
before an island is read from end to end.

Defined cases: words are maximal runs of characters other than space and 0x09-0x0D, compared by their bytes; a null or blank text has no word and no
run; rows that share a doc_id, and rows with a null doc_id, are rows like any other; an empty table gives an empty
result; other columns are ignored. A text is held whole by one task, with about 100 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import let, text_buffers, words

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Lags up to this one are scanned at every place; beyond it so many further places are looked at before an island is read.
DENSE_LAGS, PROBES = 8, 8


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many places i have ids[i] == ids[i + q], for q = 0 ... most; ids are small non-negative numbers."""
    n, size = len(ids), 1 << int(len(ids) + most).bit_length()
    often = np.bincount(ids)
    heavy = np.flatnonzero(often.astype(np.float64) ** 2 > 2.0 * size * np.log2(size))
    counts = np.zeros(most + 1, np.int64)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = often[ids] > 1
    light[np.isin(ids, heavy)] = False
    place = np.flatnonzero(light)
    place = place[np.argsort(ids[place], kind="stable")]
    last = np.cumsum(often[ids[place]][np.flatnonzero(np.diff(ids[place], prepend=-1))]) - 1  # of each word's places
    end = np.repeat(last, np.diff(last, prepend=-1))
    left, shift, found, held = np.arange(len(place)), 1, [], 0
    while True:
        left = left[left + shift <= end[left]]
        apart = place[left + shift] - place[left]
        near = apart <= most
        left, apart = left[near], apart[near]  # further places of the same word are further away
        found.append(apart)
        held += len(apart)
        if held > n + most or not len(left):
            counts += np.bincount(np.concatenate(found), minlength=most + 1)
            found, held = [], 0
        if not len(left):
            break
        shift += 1
    counts[0] = n
    return counts


def _primitive(block: np.ndarray) -> bool:
    """Whether a block is no repetition of a shorter one whose length divides its own."""
    q, rest, factor = len(block), len(block), 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            d = q // factor
            if np.array_equal(block[d:], block[:-d]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _reach(ids: np.ndarray, at: int, q: int, step: int) -> int:
    """The furthest place from at, going by step (1 or -1), up to which all places match the one q later."""
    size, limit = 64, len(ids) - q
    while True:
        a, b = (at, min(at + size, limit)) if step > 0 else (max(at + 1 - size, 0), at + 1)
        differ = np.flatnonzero(ids[a:b] != ids[a + q : b + q])
        if len(differ):
            return a + int(differ[0]) - 1 if step > 0 else a + int(differ[-1]) + 1
        if (b == limit) if step > 0 else (a == 0):
            return b - 1 if step > 0 else a
        at, size = (b, size * 2) if step > 0 else (a - 1, size * 2)


def _islands(ids: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """First and last place of every stretch of at least least places that match the one q later."""
    if q <= DENSE_LAGS:
        edge = np.flatnonzero(np.diff(np.r_[False, ids[q:] == ids[:-q], False].astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= least:
                yield int(a), int(b) - 1
        return
    same = ids[: len(ids) - q : q] == ids[q::q]
    at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
    for k in range(1, PROBES + 1):
        at = at[ids[at + (k * 2 * q) // (PROBES + 1)] == ids[at + (k * 2 * q) // (PROBES + 1) + q]]
    done = -1
    for start in at.tolist():
        if start > done:
            done = _reach(ids, start, q, 1)
            first = _reach(ids, start, q, -1)
            if done - first + 1 >= least:
                yield first, done


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start and then period."""
    n = len(ids)
    most = n // LEAST_PERIODS
    if n < LEAST_WORDS or not most:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(LEAST_WORDS - lags, (LEAST_PERIODS - 1) * lags)
    left, runs = lag_counts(ids, most), []
    for q in (1 + np.flatnonzero(left[1:] >= need[1:])).tolist():
        if left[q] < need[q]:  # what was found since explains its pairs
            continue
        for first, end in _islands(ids, q, int(need[q])):
            if _primitive(ids[first : first + q]):
                length = end - first + 1 + q
                runs.append((first, length, q))
                multiples = np.arange(2 * q, min(length, most + 1), q)
                left[multiples] -= length - multiples
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        raw, offsets = text_buffers(batch.column("text"))
        counts, found, collapsed = [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            split = raw[a:b].tobytes().split()  # bytes are split at exactly the six spaces
            known = {w: i for i, w in enumerate(dict.fromkeys(split))}
            runs = runs_of(np.fromiter(map(known.__getitem__, split), np.int64, len(split)))
            if runs:
                kept = np.ones(len(split), bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                collapsed.append(b" ".join([split[i] for i in np.flatnonzero(kept).tolist()]))
            else:
                collapsed.append(b" ".join(split))
            counts.append(len(split))
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without the words that a run
    repeats, for every row of docs(doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return plain.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) where a tenth of the texts, chosen by the crc32 of the id, repeat a part of themselves from some word on;
    a null id is not chosen."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    chosen = (h % 10 == 0) & (F.size(words(F.col("text"))) > 0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(chosen, let(words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and hashes of all runs and of the collapsed text, from find_runs."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
