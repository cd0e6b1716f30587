"""Reports: counts, JSON, SARIF, terminal and markdown texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators import diff
from inkstone.operators.rules import CATALOG

COMPACT_ABOVE = 50
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def check_summary(violations: DataFrame) -> DataFrame:
    """One row: total, errors, warnings, fixable, files, ok."""
    found = violations.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("suggested").alias("fixable"), F.count_distinct("file").alias("files"))
    return found.withColumn("ok", F.col("errors") == 0)


def by_rule(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def by_category(violations: DataFrame) -> DataFrame:
    return diff.categorised(violations).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def by_file(violations: DataFrame) -> DataFrame:
    """file and its violations in order."""
    item = F.struct("line", "col", "rule_id", "severity", "message", "suggested")
    return violations.groupBy("file").agg(F.array_sort(F.array_agg(item)).alias("violations"))


def json_rows(violations: DataFrame) -> DataFrame:
    return violations.select(F.to_json(F.struct("*")).alias("value"))


def sarif_results(violations: DataFrame) -> DataFrame:
    """One SARIF result for each violation, as JSON; rules without catalog entry have no ruleIndex."""
    catalog = violations.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(CATALOG)], "rule_id string, rule_index int")
    rows = violations.join(F.broadcast(catalog), "rule_id", "left")
    text = F.concat(F.col("message"), F.when(F.col("suggested").isNotNull(), F.concat(F.lit(" (fix: "), F.col("suggested"), F.lit(")"))).otherwise(F.lit("")))
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("col", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.col("severity").alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    return rows.select("file", "line", "col", F.to_json(result).alias("result"))


def sarif(violations: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 document in column `document`. It is a report for readers, so it has to fit into a row; write
    sarif_results for anything larger."""
    results = sarif_results(violations)
    rules = [{"id": r, "shortDescription": {"text": d}, "defaultConfiguration": {"level": s}, "properties": {"category": c}} for r, c, s, d in CATALOG]
    head = json.dumps({"$schema": SCHEMA, "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": {"name": "inkstone", "rules": ' + json.dumps(rules) + '}}, "results": ['
    return results.groupBy(F.lit(1).alias("run")).agg(F.array_join(F.array_sort(F.array_agg("result")), ",").alias("r")).select(F.concat(F.lit(head), "r", F.lit("]}]}")).alias("document"))


def terminal(violations: DataFrame) -> str:
    """A text for people; above 50 violations one line for each file."""
    total = violations.count()
    if not total:
        return "No violations"
    if total > COMPACT_ABOVE:
        rows = violations.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(COMPACT_ABOVE).collect()
        return "\n".join([*(f"{r['file']}: {r['n']}" for r in rows), f"{total} violations"])
    rows = violations.orderBy(F.collate("file", "UNICODE"), "line", "col").collect()
    return "\n".join([*(f"{r['file']}:{r['line']}:{r['col']} {r['severity']} {r['message']} [{r['rule_id']}]" + (f" -> {r['suggested']}" if r["suggested"] else "") for r in rows), f"{total} violations"])


def diff_markdown(base: DataFrame, head: DataFrame) -> str:
    s = diff.summary(base, head).first()
    new = diff.only_in(head, base)
    lines = [f"## Design check: {s['verdict']}", "", f"New {s['new']} ({s['new_errors']} errors), fixed {s['fixed']}, net {s['net_change']:+d}", ""]
    for severity, most in (("error", 10), ("warning", 5)):
        rows = new.where(F.col("severity") == severity).orderBy("file", "line", "col").limit(most).collect()
        lines += [f"- {severity}: `{r['file']}:{r['line']}` {r['message']}" for r in rows]
    lines += [f"- {r['file']}: {r['delta']:+d}" for r in diff.top_impact(base, head).collect()]
    return "\n".join(lines)


def drift_rows(drifted: DataFrame, unused: DataFrame) -> DataFrame:
    """Both directions as one table for JSON output."""
    a = drifted.select(F.lit("drifted").alias("state"), "category", "value", "n", "nearest")
    b = unused.select(F.lit("unused").alias("state"), "category", "value", F.lit(0).cast("long").alias("n"), F.col("name").alias("nearest"))
    return a.unionByName(b)
