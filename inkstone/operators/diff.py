"""Comparison of two snapshots of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators.rules import CATEGORY

KEY = ["rule_id", "file", "message"]
MANY_WARNINGS, SHOWN_FILES = 5, 5


def categorised(violations: DataFrame) -> DataFrame:
    """Adds the rule's category; unknown rules count as quality."""
    catalog = violations.sparkSession.createDataFrame(list(CATEGORY.items()), "rule_id string, category string")
    return violations.join(F.broadcast(catalog), "rule_id", "left").fillna("quality", ["category"])


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each key of left that right lacks its first violation."""
    place = F.struct("line", "col", F.struct(*left.columns))
    first = left.groupBy(*KEY).agg(F.min(place).alias("first")).join(right.select(*KEY).distinct(), KEY, "left_anti")
    return first.select(*[F.col("first")["col3"][c].alias(c) for c in left.columns])


def file_impact(base: DataFrame, head: DataFrame) -> DataFrame:
    """file, before, after, delta of every file whose count changed."""
    before = base.groupBy("file").agg(F.count(F.lit(1)).alias("before"))
    after = head.groupBy("file").agg(F.count(F.lit(1)).alias("after"))
    both = before.join(after, "file", "full").fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def top_impact(base: DataFrame, head: DataFrame, n: int = SHOWN_FILES) -> DataFrame:
    return file_impact(base, head).orderBy(F.desc(F.abs("delta")), "file").limit(n)


def summary(base: DataFrame, head: DataFrame) -> DataFrame:
    """One row: new_errors, new_warnings, new, fixed, net_change and the verdict."""
    new = only_in(head, base).agg(F.count_if(F.col("severity") == "error").alias("new_errors"), F.count_if(F.col("severity") == "warning").alias("new_warnings"), F.count(F.lit(1)).alias("new"))
    fixed = only_in(base, head).agg(F.count(F.lit(1)).alias("fixed"))
    sizes = head.agg(F.count(F.lit(1)).alias("h")).join(base.agg(F.count(F.lit(1)).alias("b")))
    verdict = F.when(F.col("new_errors") > 0, "blocking").when(F.col("new_warnings") > MANY_WARNINGS, "needs-attention").otherwise("pass")
    return new.join(fixed).join(sizes).select("new_errors", "new_warnings", "new", "fixed", (F.col("h") - F.col("b")).alias("net_change"), verdict.alias("verdict"))
