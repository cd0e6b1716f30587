"""Suppression by directives in comments: `<marker>-ignore id, id -- reason`; without ids it covers every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKER = "inkstone"


def directives(facts: DataFrame, lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """file, line, all_rules, ids for every target line. lines(file, line, text): source lines; a directive covers the next one that is neither blank
    nor a comment. On one target the last directive of a style sheet wins; those of scripts merge, and one for all rules covers all."""
    pattern = rf"{marker}-ignore\b([^\n]*)"
    said = facts.where((F.col("fact") == "comment") & F.col("value").rlike(pattern))
    ids = F.filter(F.split(F.split_part(F.regexp_extract("value", pattern, 1), F.lit("--"), F.lit(1)), r"[,\s]+"), lambda i: i != "")
    said = said.select("file", "name", F.col("line").alias("at"), "seq", ids.alias("ids"))
    code = lines.where(~F.col("text").rlike(r"^\s*(?:$|//|/\*|\*|\{/\*)")).select("file", F.col("line").alias("at"), F.col("line").alias("code_line"))
    below = Window.partitionBy("file").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    both = said.unionByName(code.join(said.select("file").distinct(), "file", "left_semi"), allowMissingColumns=True)
    targets = both.withColumn("target", F.min("code_line").over(below)).where("ids is not null and target is not null").select("file", "name", "at", "seq", "ids", F.col("target").alias("line"))
    style = targets.where("name = 'css'").groupBy("file", "line").agg(F.max_by("ids", "seq").alias("ids"))
    style = style.select("file", "line", (F.size("ids") == 0).alias("all_rules"), "ids")
    script = targets.where("name <> 'css'").groupBy("file", "line").agg(F.bool_or(F.size("ids") == 0).alias("all_rules"), F.array_distinct(F.flatten(F.array_agg("ids"))).alias("ids"))
    return style.unionByName(script)


def source_lines(sources: DataFrame) -> DataFrame:
    return sources.select("file", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).cast("int").alias("line"), "text")


def apply(violations: DataFrame, targets: DataFrame) -> DataFrame:
    """Violations that no directive covers; where there is a column `can`, only rows with it true can be covered."""
    t = targets.select(F.col("file").alias("d_file"), F.col("line").alias("d_line"), "all_rules", "ids")
    covered = (F.col("file") == F.col("d_file")) & (F.col("line") == F.col("d_line")) & (F.col("all_rules") | F.array_contains("ids", F.col("rule_id")))
    return violations.join(t, covered & F.col("can") if "can" in violations.columns else covered, "left_anti")


def suppressible(violations: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds `can`: only style blocks and component files can be suppressed; bindings in other templates cannot."""
    inline = facts.where("fact in ('decl', 'class') and kind not in ('jsx') and (origin = 'inline' or fact = 'class')").select(F.col("file").alias("i_file"), F.col("line").alias("i_line"), F.col("col").alias("i_col")).distinct()
    joined = violations.join(inline, (F.col("file") == F.col("i_file")) & (F.col("line") == F.col("i_line")) & (F.col("col") == F.col("i_col")), "left")
    return joined.withColumn("can", F.col("i_file").isNull()).drop("i_file", "i_line", "i_col")
