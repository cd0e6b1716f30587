"""Drift: values in code against a token source, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import color, values
from inkstone.operators.extract import counted, occurrences
from inkstone.operators.rules import closest_colors
from inkstone.sources.config import Tokens

KINDS = ("css", "scss", "less", "jsx", "vue", "angular", "angular-template", "svelte")
GATE, SHOWN = 10.0, 10


def token_rows(spark: SparkSession, tokens: Tokens) -> DataFrame:
    """category, name, value of every token, in the form in which code values are counted."""
    rows = [("color", n, v) for n, v in tokens.colors.items()] + [("fontFamily", f, f.lower()) for f in tokens.font_families]
    for category, scale in (("spacing", tokens.spacing), ("fontSize", tokens.font_sizes), ("radius", tokens.radii)):
        rows += [(category, f"{v:g}", f"{v:g}") for v in scale]
    found = spark.createDataFrame(rows, "category string, name string, value string")
    hexed = F.when(F.col("category") == "color", color.normalise(F.col("value"))).otherwise(F.col("value"))
    return found.withColumn("value", hexed).where("value is not null")


def _shown(seen: DataFrame) -> DataFrame:
    """Families in lower case, and every value as written beside it."""
    return seen.withColumn("shown", F.col("value")).withColumn("value", F.when(F.col("category") == "fontFamily", F.lower("value")).otherwise(F.col("value")))


def found_values(facts: DataFrame) -> DataFrame:
    """category, value (families in lower case), shown (as written), file, line, col of every value in code."""
    return _shown(occurrences(facts, KINDS, skip_tokens=True))


def code_values(facts: DataFrame) -> DataFrame:
    """category, value, shown and n of every value in code; where each one stands are the rows of found_values."""
    return _shown(counted(facts, KINDS, skip_tokens=True)).groupBy("category", "value").agg(F.min("shown").alias("shown"), F.sum("n").alias("n"))


def drifted(used: DataFrame, tokens: Tokens) -> DataFrame:
    """Code values that are no token, with the nearest token within its category's reach."""
    known = token_rows(used.sparkSession, tokens)
    off = used.join(F.broadcast(known.select("category", "value").distinct()), ["category", "value"], "left_anti")
    number = F.col("value").try_cast("double")
    near = F.lit(None).cast("double")
    for category, scale, most in (("spacing", tokens.spacing, values.SPACING_NEAR), ("fontSize", tokens.font_sizes, values.FONT_NEAR), ("radius", tokens.radii, values.RADIUS_NEAR)):
        near = F.when(F.col("category") == category, values.nearest(number, scale, most)).otherwise(near)
    lookup = closest_colors(off.where("category = 'color'").select("value"), tokens.colors).withColumnRenamed("value", "near_value")
    placed = off.join(lookup, F.when(F.col("category") == "color", F.col("value")) == F.col("near_value"), "left").drop("near_value")
    return placed.withColumn("nearest", F.coalesce("token", F.concat(values.number_text(near), F.lit("px")))).drop("token").orderBy(F.desc("n"), "category", "value")


def unused(used: DataFrame, tokens: Tokens) -> DataFrame:
    """Tokens that code never uses."""
    return token_rows(used.sparkSession, tokens).join(used.select("category", "value"), ["category", "value"], "left_anti")


def summary(used: DataFrame, tokens: Tokens) -> DataFrame:
    """One row: unique_values, drifted, unused, drift_percent (0 without values), gate (true if it is 10 or more). Code values, one row each, are
    read once: tokens that none of them meets are what is left of all tokens."""
    known = token_rows(used.sparkSession, tokens).groupBy("category", "value").agg(F.count(F.lit(1)).alias("tokens"))
    met = used.select("category", "value").join(F.broadcast(known), ["category", "value"], "left")
    both = met.agg(F.count(F.lit(1)).alias("unique_values"), F.count_if(F.col("tokens").isNull()).alias("drifted"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("met"))
    gone = both.join(known.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))).select("unique_values", "drifted", (F.col("all") - F.col("met")).alias("unused"))
    percent = F.when(F.col("unique_values") == 0, 0.0).otherwise(F.col("drifted") * 100 / F.col("unique_values"))
    return gone.withColumn("drift_percent", percent).withColumn("gate", F.col("drift_percent") >= GATE).withColumn("dots", values.drift_dots(F.col("drift_percent") / 100))
