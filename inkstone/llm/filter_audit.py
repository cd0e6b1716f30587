"""How filters over documents interact: what each removes in every order of the five, what it would have removed had it come first,
what only it removes, and what good or toxic text goes with it.

Four filters look at a text alone; E removes copies, which are found by partition refinement. Texts are split into classes by their
length in code points, then by the hash of one block of the text after the other, each 16 times as long as the one before; a class of one text is
dropped as soon as it is one. Of the classes that are left the whole texts are compared, so a text that only shares its hashes with another
is no copy. Then every document is a mask of five bits; documents are counted by part and mask, and all 120 orders are
worked out from these counts, whose number does not depend on that of the documents.

Defined cases: a null text is the empty one; a null language is the part ''; a null doc_id is never smaller or larger than another, so such rows are
neither copies of others nor others of theirs; rows that share a doc_id are rows like any other, and none is a copy of the
other; a doc_id that labels repeats is good, or toxic, if one of its rows says so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import let, materialize, words

FILTERS = "ABCDE"
#: Code points of the first block of a text, and how many times longer each further one is; so many blocks hold any text.
FIRST_BLOCK, LONGER, BLOCKS = 64, 16, 7


def bit(name: str, fails: Column) -> Column:
    return F.when(fails, 1 << FILTERS.index(name)).otherwise(0)


def text_mask(text: Column) -> Column:
    """The bits of the filters that need nothing but the text."""
    by_words = let(words(text), lambda w: bit("A", F.size(w) < 200) + bit("B", 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (by_words + bit("C", 100 * capitals > 3 * F.length(text)) + bit("D", text.rlike("[#$%&*|]"))).cast("int")


def blocks(text: Column) -> Column:
    """Hashes of the blocks of a text, as many as it has."""
    sizes = [FIRST_BLOCK * LONGER**k for k in range(BLOCKS)]
    starts = [sum(sizes[:k]) for k in range(BLOCKS)]
    bounds = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in zip(starts, sizes, strict=True)])
    held = let(F.length(text), lambda length: F.filter(bounds, lambda b: b["a"] < length))
    return F.transform(held, lambda b: F.xxhash64(text.substr(b["a"] + 1, b["n"])))


def refined(key: Column, block: Column) -> Column:
    """The class of a text after one more block; one without such a block stays in its class."""
    return F.when(block.isNull(), key).otherwise(F.xxhash64(key, block))


def class_key(text: Column) -> Column:
    """The class of a text after all its blocks."""
    return F.aggregate(blocks(text), F.xxhash64(F.length(text)), refined)


def surviving_classes(prints: DataFrame) -> DataFrame:
    """key: the classes of two rows or more that are left of prints(length, blocks) after all blocks."""
    rows = prints.select(F.xxhash64("length").alias("key"), "blocks")
    most = prints.agg(F.max(F.size("blocks"))).first()[0] or 0
    for level in range(most + 1):  # at most BLOCKS + 1
        if level:
            rows = rows.select(refined(F.col("key"), F.get("blocks", F.lit(level - 1))).alias("key"), "blocks")
        several = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "audit-classes")
        if level < most:
            rows = materialize(rows.join(several.hint("shuffle_hash"), "key", "left_semi"), "audit-rows")
    return several


def smallest_ids(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of docs(id, text): (key, low) with the smallest id of every class whose texts are all equal; and (key, text, low) of
    classes of several texts that share all hashes, if there are any."""
    several = surviving_classes(prints)
    texts = docs.select(class_key(F.col("text")).alias("key"), "text", "id").join(several.hint("shuffle_hash"), "key", "left_semi")
    lows = texts.groupBy("key", "text").agg(F.min("id").alias("low"))  # whole texts compared; merged in each task before they are sent
    lows = materialize(lows.select("key", "low"), "audit-lows")
    counted = lows.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("low"))
    alike = counted.where("texts = 1").select("key", "low")
    mixed = counted.where("texts > 1").select("key")
    if mixed.isEmpty():
        return alike, None
    return alike, texts.join(mixed, "key", "left_semi").groupBy("key", "text").agg(F.min("id").alias("low"))


def masks(docs: DataFrame) -> DataFrame:
    """id, part and mask (a bit for each filter failed, A the lowest) of every row of docs(doc_id, text, lang)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    mask = text_mask(F.col("text"))
    prints = materialize(own.select("id", "part", mask.alias("mask"), F.length("text").alias("length"), blocks(F.col("text")).alias("blocks")), "audit-prints")
    alike, mixed = smallest_ids(own, prints)
    copy = bit("E", F.col("low") < F.col("id"))
    keyed = prints.withColumn("key", F.aggregate("blocks", F.xxhash64("length"), refined))
    out = keyed.join(alike.hint("merge"), "key", "left").select("id", "part", (F.col("mask") + copy).alias("mask"))
    if mixed is None:
        return out
    some = mixed.select("key").distinct()  # classes in which all hashes agree and the texts do not: decided by the texts
    clear = keyed.join(some, "key", "left_anti").join(alike, "key", "left").select("id", "part", (F.col("mask") + copy).alias("mask"))
    unclear = own.select("id", "part", mask.alias("mask"), class_key(F.col("text")).alias("key"), "text").join(mixed, ["key", "text"])
    return clear.unionByName(unclear.select("id", "part", (F.col("mask") + copy).alias("mask")))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents, good and toxic ones it has."""
    counted = masks(docs).groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("marked")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    joined = counted.join(marks.hint("merge"), F.col("id") == F.col("marked"), "left")
    sums = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = [(order, step, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[: step - 1])) for order in map("".join, permutations(FILTERS)) for step, f in enumerate(order, 1)]
    every = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, s, b, e in steps])
    counted = materialize(cells(docs, labels), "audit-cells")
    spread = counted.select("part", "mask", "n", "good", "toxic", F.explode(every).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(value: str, where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col(value)).otherwise(0)).cast("long").alias(name)

    found = spread.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~gone & ~fails, "kept"), total("n", ~gone & fails, "removed"), total("n", gone & fails, "redundant"), total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", ~gone & fails, "good_lost"), total("toxic", ~gone & fails, "toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
