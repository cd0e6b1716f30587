"""Cross-file analyses: unused tokens, spacing close to a token, near-duplicate components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import values
from inkstone.operators.rules import facts_of, parts_of, severity_of, violation
from inkstone.schema import COLUMNS
from inkstone.sources.config import Config

SKIPPED_TOKENS = ("--tw-", "--vp-", "--_")
LEAST_SCALE, LEAST_COMPONENTS, MOST_PAIRS = 5, 5, 50
TOTAL_LIMIT, NAME_LIMIT = 0.75, 0.5


def definitions(facts: DataFrame) -> DataFrame:
    """Declarations of custom properties on :root that count as tokens."""
    defined = facts_of(facts, "decl").where((F.trim("selector") == ":root") & F.col("name").startswith("--"))
    for prefix in SKIPPED_TOKENS:
        defined = defined.where(~F.col("name").startswith(prefix))
    return defined


def references(facts: DataFrame) -> DataFrame:
    """name of every reference to a custom property in a declaration."""
    return facts_of(facts, "decl").where(F.col("value").contains("var(")).select(F.explode(values.var_refs(F.col("value"))).alias("name"))


def token_names(facts: DataFrame) -> DataFrame:
    """name, defined, used: how often facts define and refer to each token."""
    both = definitions(facts).select("name", F.lit(1).cast("long").alias("defined"), F.lit(0).cast("long").alias("used")).unionByName(references(facts).select("name", F.lit(0).cast("long").alias("defined"), F.lit(1).cast("long").alias("used")))
    return both.groupBy("name").agg(F.sum("defined").alias("defined"), F.sum("used").alias("used"))


def dead_definitions(defined: DataFrame) -> DataFrame:
    return violation(defined, "no-dead-token", F.concat(F.col("name"), F.lit(" is never used")))


def dead_tokens(facts: DataFrame) -> DataFrame:
    """Custom properties defined on :root that no declaration refers to; each definition counts."""
    return dead_definitions(definitions(facts).join(references(facts).distinct(), "name", "left_anti"))


def near_spacing(facts: DataFrame, scale: list[float]) -> DataFrame:
    """Parts of spacing values in style blocks that miss a scale of five or more values by at most 4 px."""
    parts = parts_of(facts_of(facts, "decl").where("origin = 'css'").where(F.col("name").rlike(values.SPACING_PROP)))
    parts, px = values.once(parts, px=values.px_of(F.col("part"))), F.col("px")
    parts, near = values.once(parts, near=values.nearest(px, scale, values.SPACING_NEAR)), F.col("near")
    found = parts.where(~values.in_scale(px, scale) & near.isNotNull()) if len(scale) >= LEAST_SCALE else parts.where("false")
    return violation(found, "spacing-near-token", F.concat(F.lit('"'), F.col("part"), F.lit('" is close to '), values.number_text(near), F.lit("px")), F.concat(values.number_text(near), F.lit("px")), F.col("part"))


def supersede(violations: DataFrame, near: DataFrame) -> DataFrame:
    """Spacing violations without those that a near-token one stands for."""
    key = ["rule_id", "file", "line", "col", "old_value"]
    stands = near.withColumn("rule_id", F.lit("no-arbitrary-spacing")).select(*key).distinct()
    return violations.join(stands, key, "left_anti").select(*COLUMNS)


def similar_pairs(components: DataFrame, total: float = TOTAL_LIMIT, name: float = NAME_LIMIT) -> DataFrame:
    """Pairs of components(key, name, props, structure) with key_a < key_b, their three similarities and score.

    Every term is at most 1, so a total of .75 needs a structure similarity of 2/7 or more: such sets share an element, or
    are both empty. Candidates therefore meet on shared elements, the rarest ones first: an element is left out of the meeting if the pair
    must share a rarer one too (prefix filtering with the least overlap that 2/7 allows)."""
    least = (total - 0.65) / 0.35
    sets = components.select("key", "name", F.array_distinct("props").alias("props"), F.array_distinct("structure").alias("structure"))
    marked = sets.withColumn("e", F.explode(F.when(F.size("structure") == 0, F.array(F.lit("\x00"))).otherwise(F.col("structure"))))
    often = marked.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    ranked = marked.join(often, "e").groupBy("key").agg(F.array_sort(F.array_agg(F.struct("n", "e"))).alias("by"))
    # A set of s elements shares at least ceil(least * s) with any partner, so one of its s - that + 1 rarest is shared.
    prefix = F.slice("by", F.lit(1), (F.size("by") - F.ceil(F.size("by") * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))
    keys = ranked.select("key", F.explode(prefix).alias("b")).select("key", F.col("b.e").alias("e"))
    pairs = keys.alias("x").join(keys.alias("y"), (F.col("x.e") == F.col("y.e")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b")).distinct()
    a = sets.select(*[F.col(c).alias(f"{c}_a") for c in sets.columns])
    b = sets.select(*[F.col(c).alias(f"{c}_b") for c in sets.columns])
    scored = pairs.join(a, "key_a").join(b, "key_b")
    scored = scored.withColumns({"name_sim": values.name_similarity(F.col("name_a"), F.col("name_b")), "props_sim": values.jaccard(F.col("props_a"), F.col("props_b")), "structure_sim": values.jaccard(F.col("structure_a"), F.col("structure_b"))})
    scored = scored.withColumn("score", values.variant_score(F.col("name_sim"), F.col("props_sim"), F.col("structure_sim")))
    return scored.where((F.col("score") >= total) & (F.col("name_sim") >= name)).select("key_a", "key_b", "name_a", "name_b", "name_sim", "props_sim", "structure_sim", "score")


def variant_sprawl(facts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Near-duplicate components, on the later of each pair by file and line; one summary if there are too many."""
    order = F.struct(F.collate("file", "UNICODE"), F.col("line"), F.col("col"))
    found = facts_of(facts, "component", "jsx").where((F.size("structure") > 0) & F.col("name").rlike("^[A-Z][A-Za-z0-9]*$")).withColumn("key", F.concat_ws("\x00", F.col("file"), F.lpad(F.col("line").cast("string"), 9, "0"), F.col("col").cast("string")))
    none = violation(found.where("false"), "variant-sprawl", F.lit(""))
    if found.limit(LEAST_COMPONENTS).count() < LEAST_COMPONENTS:
        return none
    pairs = similar_pairs(found)
    where_a = found.select(F.col("key").alias("key_a"), order.alias("order_a"), F.col("file").alias("file_a"), F.col("line").alias("line_a"), F.col("col").alias("col_a"))
    where_b = found.select(F.col("key").alias("key_b"), order.alias("order_b"), F.col("file").alias("file_b"), F.col("line").alias("line_b"), F.col("col").alias("col_b"))
    placed = pairs.join(where_a, "key_a").join(where_b, "key_b")
    later = F.col("order_a") > F.col("order_b")
    pick = lambda c: F.when(later, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    rows = placed.withColumns({"file": pick("file"), "line": pick("line"), "col": pick("col"), "late": pick("name"), "early": F.when(later, F.col("name_b")).otherwise(F.col("name_a"))})
    count = rows.limit(most_pairs + 1).count()
    if count > most_pairs:
        first = rows.agg(F.min(F.struct("file", "line", "col")).alias("s"), F.count(F.lit(1)).alias("n")).select("s.file", "s.line", "s.col", "n")
        return violation(first, "variant-sprawl", F.concat(F.col("n").cast("string"), F.lit(" pairs of components are near duplicates")))
    return violation(rows, "variant-sprawl", F.concat(F.col("late"), F.lit(" is "), F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit(" % like "), F.col("early")))


def analyse(facts: DataFrame, violations: DataFrame, config: Config) -> DataFrame:
    """violations with the cross-file ones: unused tokens, near tokens (which stand for spacing ones), near duplicates."""
    out = violations.select(*COLUMNS)
    if (severity := severity_of("no-dead-token", config)) is not None:
        out = out.unionByName(dead_tokens(facts).withColumn("severity", F.lit(severity)))
    if (severity := severity_of("spacing-near-token", config)) is not None:
        near = near_spacing(facts, config.tokens.spacing).withColumn("severity", F.lit(severity))
        out = supersede(out, near).unionByName(near)
    if severity_of("variant-sprawl", config) is not None and config.plan != "free":
        out = out.unionByName(variant_sprawl(facts))  # always a warning, whatever is configured
    return out
