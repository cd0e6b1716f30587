"""Mixing sources to target weights by cube-method balanced sampling.

Each document is taken floor(rate) times, where rate is its source's target over its source's size, and once more with a
chance equal to the fraction of rate. The cube method settles those chances: the flight moves three documents' chances at a time
along the null space of two constraints, the expected tokens and the expected number of documents, until one of the three is 0 or
1. A chunk ends with at most two open documents; the open ones of all chunks fly again in larger company until each
source has one chunk, and its last two are landed on the choice nearest to the target.

Sources weigh 3, 1, 2 and again, in code point order with null last; they share 150 % of all sizes; a target stops at twice its
source's size and what it leaves over is shared again by weight.

Defined cases: null texts and blank texts have size 0 and are taken 0 words; rows equal in doc_id, source and size are one
unit of many, whose whole copies are settled by count; null ids and sources are ordinary values; an empty table gives an
empty result; other columns are ignored here, and kept by apply_mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import materialize, row_key, unused, with_position, words

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 11
#: Documents that fly together in one task's chunk.
CHUNK = 2048


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for units(source, size, n). The level that water-filling reaches is found by
    aggregates over the sources; each round caps those that stand above and raises the rest."""
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    ranked = with_position(per.withColumn("last", F.col("source").isNull().cast("int")), ["last", "source"], "rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)), "mix-weights")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        used, open_weight = table.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        new = (total - (used or 0.0)) / open_weight if open_weight else level
        if not open_weight or new <= level:
            break
        level = new
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if level else F.lit(0.0)
    return table.select("source", "source_size", "docs", target.cast("double").alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase on one chunk: chances after it, at most two of them strictly between 0 and 1. Total chance and total
    expected size stay as they were."""
    chance = chance.copy()
    size = size.astype(float)
    draws = rng.random(2 * len(chance) + 4)
    held: list[int] = []
    used = 0
    for i in np.flatnonzero((chance > 0) & (chance < 1)):
        held.append(int(i))
        while len(held) == 3:
            a, b, c = held
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - chance[k]) / v if v > 0 else chance[k] / -v for k, v in zip(held, u, strict=True) if v)
            down = min(chance[k] / v if v > 0 else (1 - chance[k]) / -v for k, v in zip(held, u, strict=True) if v)
            step = up if draws[used] * (up + down) < down else -down
            used += 1
            for k, v in zip(held, u, strict=True):
                moved = chance[k] + step * v
                chance[k] = 0.0 if moved < 1e-9 else 1.0 if moved > 1 - 1e-9 else moved
            held = [k for k in held if 0 < chance[k] < 1]
    return chance


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Landing: of the roundings of the open chances, the one that keeps the expected tokens best, then the documents."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    best = None
    for pick in range(1 << len(open_)):
        bits = np.array([pick >> k & 1 for k in range(len(open_))], float)
        off = (abs(((bits - chance[open_]) * size[open_]).sum()), abs((bits - chance[open_]).sum()), pick)
        if best is None or off < best[0]:
            best = (off, bits)
    out = chance.copy()
    if len(open_):
        out[open_] = best[1]
    return out


def _fly_chunks(level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "size", "doc_key"], kind="stable").reset_index(drop=True)
        seed = [SEED, level, int(key[1]), int(rows["order"].iloc[0]) & 0x7FFFFFFF]
        size = rows["size"].to_numpy(float)
        chance = fly(size, rows["chance"].to_numpy(float), np.random.default_rng(seed))
        rows["chance"] = land(size, chance) if last else chance
        return rows

    return run


def settle(units: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """units with chance moved to 0 or 1. units: doc_id, source, size, n, whole, chance and the source's docs."""
    columns = units.columns
    todo = materialize(units.withColumn("order", F.xxhash64("doc_id", "size")).withColumn("doc_key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("open", F.col("docs")), "mix-units")
    done: DataFrame | None = None
    level = 0
    while True:
        most = todo.agg(F.max("open")).first()[0]
        last = most is None or most <= chunk
        chunks = F.ceil(F.col("open") / F.lit(float(chunk))).cast("long")
        dealt = todo.withColumn("chunk", F.pmod(F.xxhash64("order", F.lit(level)), chunks)).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
        flown = materialize(dealt.groupBy("src", "chunk").applyInPandas(_fly_chunks(level, last), dealt.schema), f"mix-flight{level}").drop("chunk", "src", "open")
        settled = flown if last else flown.where("chance = 0 or chance = 1")
        done = settled.select(*columns) if done is None else done.unionByName(settled.select(*columns))
        if last:
            return done
        left = flown.where("chance > 0 and chance < 1")
        counts = left.groupBy(F.col("source").alias("open_source")).agg(F.count(F.lit(1)).alias("open"))
        todo = materialize(left.join(counts, F.col("source").eqNullSafe(F.col("open_source"))).drop("open_source"), f"mix-left{level}")
        level += 1


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """One row for each distinct (doc_id, source, size) of docs(doc_id, source, text): n rows of it, extra of which are taken
    whole + 1 times and the others whole times; with the source's size and target."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"))
    units = materialize(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = source_targets(units, weights, share, most)
    t = targets.withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rated = units.join(t, units["source"].eqNullSafe(t["t_source"])).drop("t_source").withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("n") * (F.col("rate") - F.floor("rate")))
    rated = rated.withColumn("sure", F.floor("part").cast("long")).withColumn("chance", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("part") - F.col("sure"))).drop("rate", "part")
    return settle(rated, chunk).select("doc_id", "source", "size", "n", "whole", (F.col("sure") + F.col("chance").cast("long")).alias("extra"), "source_size", "target")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    each = decide(docs, **options).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    taken = F.col("size") * (F.col("whole") + (F.col("copy") <= F.col("extra")).cast("long"))
    return each.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows that it doesn't take go, and so do rows without a word.
    Of n rows equal in doc_id, source and size, extra are taken once more than the others, as mix() says: the first by a hash of
    the row. Columns are those of docs; names for working columns are chosen so that they clash with none of them."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = ("mix_id", "mix_source", "mix_size", "mix_copies", "mix_extra", "mix_hash", "mix_tie", "mix_place", "mix_first")
    id_, source, size, copies, extra, hash_, tie, place, first = (unused(n, docs.columns) for n in names)
    key = [id_, source, size]
    units = decide(docs, **options).where("size > 0 and whole * n + extra > 0")
    each = F.col("whole") + F.when(F.col("extra") >= F.col("n"), 1).otherwise(0)
    uneven = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    units = materialize(units.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), "whole", F.col("extra").alias(extra), each.alias(copies), uneven.alias("uneven")), "mix-copies")
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(source, F.col("source").cast("string")).withColumn(size, F.size(words(F.col("text"))).cast("long")).where(F.col(size) > 0)

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        """Null-safe on the key; the units are the hashed side at every size, as the texts are the larger one at every size."""
        same = [left[c].eqNullSafe(right[c]) for c in key]
        return left.join(right.hint("shuffle_hash"), same[0] & same[1] & same[2]).drop(*[right[c] for c in key])

    def repeat(rows: DataFrame, n: Column) -> DataFrame:
        return rows.withColumn(place, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*columns)

    out = repeat(join(keyed, units.where(~F.col("uneven") & (F.col(copies) > 0)).select(*key, copies)), F.col(copies))
    ragged = units.where("uneven")
    if ragged.isEmpty():
        return out
    # Equal rows are numbered in ranges of a hash of the row, so that a group of any size is cut into pieces.
    rows = join(keyed, ragged.select(*key, F.col("whole").alias(copies), extra))
    rows = rows.withColumn(hash_, row_key(docs)).withColumn(tie, F.rand(SEED))
    numbered = materialize(with_position(rows, [*key, hash_, tie], place, "mix-uneven"), "mix-numbered")
    firsts = materialize(numbered.groupBy(*key).agg(F.min(place).alias(first)), "mix-firsts")
    return out.unionByName(repeat(join(numbered, firsts), F.col(copies) + (F.col(place) - F.col(first) < F.col(extra)).cast("long")))
