"""Benchmark decontamination: containment search by MinHash over size partitions, verified exactly.

Items are partitioned by their number of distinct shingles, at powers of two. In a partition of sizes up to u each item's sketch is its
floor((1 - t) u) + 1 smallest shingle hashes. A document that holds a share t of an item's shingles lacks fewer shingles than
the sketch has, so at least one sketch hash is among the document's own: documents, however long, are not
sketched but probe the sketches with all their shingle hashes, and no pair at t or more is lost. Candidates are verified by the
exact count of the item's shingles in the document.

A shingle is `width` words, lower-cased and space-joined; an item with fewer words is one shingle of all its words, which documents
are then probed for at that width too. Defined cases: null and blank texts have no shingle, match nothing and are never matched; rows that share a doc_id
(or an item_id) count as variants of it and the best containment stands; null ids are ordinary values; empty tables give an empty
result; other columns are ignored. drop_contaminated judges rows, not ids, and keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import let, materialize, row_key, unused, words

WIDTH, THRESHOLD = 5, 0.8


def _shingle_strings(text: Column, width: Column) -> Column:
    """Distinct space-joined runs of width words."""
    return let(
        words(F.lower(text)),
        lambda w: F.when((F.size(w) >= width) & (width > 0), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " ")))).otherwise(F.array().cast("array<string>")),
    )


def _probe_hashes(text: Column, widths: list[int]) -> Column:
    """Hashes of all runs of each of the widths."""

    def runs(w: Column, k: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
        return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<bigint>"))

    def of(w: Column) -> Column:
        each = [runs(w, k) for k in widths]
        return each[0] if len(each) == 1 else F.concat(*each)

    return let(words(F.lower(text)), of)


def sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, width, size (distinct shingles), shingles and sketch (hashes) of every item with a word."""
    worded = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.size(words(F.col("text"))).alias("n")).where("n > 0")
    own = worded.withColumn("width", F.least(F.lit(width), F.col("n"))).withColumn("shingles", _shingle_strings(F.col("text"), F.col("width")))
    sized = own.withColumn("size", F.size("shingles")).withColumn("most", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double")))))
    depth = (F.floor(F.col("most") * F.lit(1 - threshold) + F.lit(1e-9)) + 1).cast("int")
    sketch = F.slice(F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s)))), F.lit(1), depth)
    return sized.select("item_id", "width", "size", "shingles", sketch.alias("sketch"))


def _held(docs: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """key, item_id, n_item, n_found of docs(key, text) for every key and item of the index with at least threshold of the item's shingles in
    a text of that key; a key with several texts may come more than once."""
    widths = sorted(r["width"] for r in index.select("width").distinct().collect()) or [WIDTH]  # at most `width` values
    keyed = materialize(index.select(F.explode("sketch").alias("h"), "item_id"), "contain-sketches")
    probes = docs.select("key", F.explode(_probe_hashes(F.col("text"), widths)).alias("h"))
    pairs = materialize(probes.join(keyed, "h").select("key", "item_id").distinct(), "contain-pairs")
    ids = pairs.select(F.col("key").alias("p_key"), F.col("item_id").alias("p_item"))
    suspects = docs.join(ids, docs["key"].eqNullSafe(ids["p_key"])).select("key", "text", "p_item")
    both = suspects.join(index, suspects["p_item"].eqNullSafe(index["item_id"]))
    found = both.select("key", "item_id", F.col("size").cast("long").alias("n_item"), F.size(F.array_intersect("shingles", _shingle_strings(F.col("text"), F.col("width")))).cast("long").alias("n_found"))
    return found.where(F.col("n_found") / F.col("n_item") >= threshold)


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment for every document that holds at least threshold of an item's shingles."""
    index = materialize(sketches(items, width, threshold), "contain-items")
    exact = _held(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), index, threshold).withColumn("containment", F.round(F.col("n_found") / F.col("n_item"), 6))
    best = F.max(F.struct("containment", "n_item", "n_found"))
    return exact.groupBy("key", "item_id").agg(best.alias("b")).select(F.col("key").alias("doc_id"), "item_id", "b.n_item", "b.n_found", "b.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs. Each row is judged by its own text, whatever rows share its doc_id."""
    index = materialize(sketches(items, width, threshold), "contain-items")
    found = _held(docs.select(row_key(docs).alias("key"), "text"), index, threshold).select("key").distinct()
    key = unused("bad_key", docs.columns)
    bad = materialize(found.withColumnRenamed("key", key), "contain-bad")
    return docs.join(bad, row_key(docs) == bad[key], "left_anti")
