"""Baselines: fingerprints of known violations, and what is new, known or gone against them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import values
from inkstone.sources.config import Config

ENTRIES = "fingerprint string, ruleId string, file string"


def fingerprinted(violations: DataFrame, root: str = "") -> DataFrame:
    """violations with rel_file, occurrence and fingerprint. Occurrences of one rule, file and message are numbered by place, so a line inserted
    above changes nothing."""
    rows = violations.withColumn("rel_file", values.relative_path(F.col("file"), root))
    at = Window.partitionBy("rule_id", "rel_file", "message").orderBy("line", "col")
    numbered = rows.withColumn("occurrence", F.row_number().over(at) - 1)
    return numbered.withColumn("fingerprint", values.fingerprint(F.col("rule_id"), F.col("rel_file"), F.col("message"), F.col("occurrence")))


def read(spark: SparkSession, path: str | Path) -> DataFrame:
    """Stored entries; a missing or malformed file has none."""
    try:
        data = json.loads(Path(path).read_text())
        rows = [(e["fingerprint"], e["ruleId"], e["file"]) for e in data["entries"]]
    except (OSError, ValueError, KeyError, TypeError):
        rows = []
    return spark.createDataFrame(rows, ENTRIES)


def entries(violations: DataFrame, root: str = "") -> DataFrame:
    """One entry for each fingerprint."""
    rows = fingerprinted(violations, root)
    return rows.groupBy("fingerprint").agg(F.first("rule_id").alias("ruleId"), F.first("rel_file").alias("file"))


def write(stored: DataFrame, path: str | Path) -> None:
    """The entries, ascending, as a version 1 file."""
    rows = [r.asDict() for r in stored.dropDuplicates(["fingerprint"]).orderBy("fingerprint").collect()]
    Path(path).write_text(json.dumps({"version": 1, "entries": rows}, indent=2) + "\n")


def apply(violations: DataFrame, stored: DataFrame, root: str = "", mode: str = "filter") -> DataFrame:
    """mode filter: violations that are not stored; mode all: all of them, with `frozen` where they are."""
    rows = fingerprinted(violations, root)
    known = stored.select("fingerprint").distinct()
    if mode == "filter":
        return rows.join(known, "fingerprint", "left_anti").withColumn("frozen", F.lit(False))
    return rows.join(known.withColumn("frozen", F.lit(True)), "fingerprint", "left").fillna(False, ["frozen"])


def counts(violations: DataFrame, stored: DataFrame, root: str = "") -> DataFrame:
    """One row: total, baselined, new, resolved, baseline_total."""
    rows = fingerprinted(violations, root).select("fingerprint")
    known = stored.select("fingerprint").distinct()
    now = rows.join(known.withColumn("known", F.lit(True)), "fingerprint", "left").agg(F.count(F.lit(1)).alias("total"), F.count("known").alias("baselined"))
    gone = stored.join(rows.distinct(), "fingerprint", "left_anti").agg(F.count(F.lit(1)).alias("resolved"))
    size = stored.agg(F.count(F.lit(1)).alias("baseline_total"))
    return now.join(gone).join(size).select("total", "baselined", (F.col("total") - F.col("baselined")).alias("new"), "resolved", "baseline_total")


def prune(stored: DataFrame, violations: DataFrame, root: str = "") -> DataFrame:
    """Stored entries that still occur."""
    return stored.join(fingerprinted(violations, root).select("fingerprint"), "fingerprint", "left_semi")


def resolve(spark: SparkSession, violations: DataFrame, config: Config, root: str) -> tuple[str, DataFrame]:
    """Status (disabled, file-missing, active) and the violations to report."""
    path = Path(root) / config.baseline_path
    if not config.baseline_enabled:
        return "disabled", violations
    if not path.is_file():
        return "file-missing", violations
    return "active", apply(violations, read(spark, path), root)
