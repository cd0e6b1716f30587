"""A store of facts by content: a text of one kind is parsed once for a version of the parsers, whatever files hold it and however often it comes back.

Facts depend on a text and its kind alone, so they are kept under both, without a file. A row `parsed` marks every text that was read, also one
without facts; the marks and the facts of a batch are written by one job. A renamed or copied file and a change that is taken back find their
facts here. The store is cut into buckets by content, and a batch reads those only that its texts fall into.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import facts as parsing
from inkstone.schema import FACTS

BUCKETS = 64
MEMO = f"{FACTS}, version int, batch string, bucket int"


def _read(spark: SparkSession, store: str) -> DataFrame:
    """The store, empty if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MEMO)
    return spark.read.schema(MEMO).parquet(store)


@contextmanager
def written(rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """rows, computed once and kept in a new folder in this one for as long as they are used. Spark joins the small partitions of what is written, but not of
    what is persisted, so that what comes after has tasks by the size of the rows."""
    spark, path = rows.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    try:
        rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parse(sources: DataFrame, store: str, batch: str = "") -> DataFrame:
    """Facts of sources(file, content), as operators.facts.parse gives them; texts that the store lacks are parsed and added to it under the name of the
    batch."""
    spark = sources.sparkSession
    own = parsing.parseable(sources).withColumn("content", F.coalesce("content", F.lit(""))).withColumn("text_id", F.sha2(F.col("content").cast("binary"), 256))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("text_id"), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # BUCKETS at most
        current = (F.col("version") == parsing.PARSER_VERSION) & F.col("bucket").isin(touched)
        known = _read(spark, store).where(current & (F.col("fact") == "parsed")).select(F.col("file").alias("text_id"), "kind")
        lacking = own.select("text_id", "kind", "content", "bucket").dropDuplicates(["text_id", "kind"]).join(known, ["text_id", "kind"], "left_anti")
        with written(lacking, f"{store}-new") as new:
            if not new.isEmpty():
                found = parsing.parse_as_kind(new.select(F.col("text_id").alias("file"), "content", "kind"))
                marks = new.select(F.col("text_id").alias("file"), "kind", F.lit("parsed").alias("fact"))
                rows = found.unionByName(marks, allowMissingColumns=True).withColumns({"version": F.lit(parsing.PARSER_VERSION), "batch": F.lit(batch), "bucket": F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int")})
                rows.write.mode("append").partitionBy("bucket").parquet(store)
        held = _read(spark, store).where(current & (F.col("fact") != "parsed")).drop("version", "batch", "bucket").dropDuplicates()
        files = own.select(F.col("file").alias("in_file"), F.col("kind").alias("in_kind"), "text_id")
        names = [c.split()[0] for c in FACTS.split(", ")]
        joined = files.join(held, (F.col("text_id") == F.col("file")) & (F.col("in_kind") == F.col("kind")))
        return joined.select(F.col("in_file").alias("file"), *names[1:])
    finally:
        own.unpersist()


def parsed_texts(spark: SparkSession, store: str) -> DataFrame:
    """batch and how many texts it had to parse."""
    return _read(spark, store).where("fact = 'parsed'").groupBy("batch").agg(F.count_distinct("file", "kind", "version").alias("parsed"))
