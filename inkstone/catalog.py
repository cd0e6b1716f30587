"""The registered queries over the driver's tables and their DuckDB counterparts.

The tables hold no style sheets, so facts are derived from columns by expressions that both engines share, or rendered to source text first and
read back by the parsers. Every query runs the library's own operators over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import color, values
from inkstone.operators import baseline, cross, diff, drift, extract, facts, fix, report, rules, suppress
from inkstone.schema import FACTS
from inkstone.session import scratch_folder
from inkstone.sources import tokens
from inkstone.sources.config import Config, Tokens
from inkstone.sources.files import kind_of
from inkstone.streaming import memo, watch

TOKENS = Tokens({"primary": "#3b82f6", "danger": "#ef4444", "ok": "#22c55e", "ink": "#111827", "paper": "#ffffff"}, [4, 8, 12, 16, 24, 32], [12, 14, 16, 18, 24], [4, 8, 12], ["Brand#11", "Brand#22", "Brand#33"])
CONFIG = Config(TOKENS)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A small table over all cores: each of its rows becomes a file to parse."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def as_facts(rows: DataFrame, fact: str, **columns) -> DataFrame:
    """Rows in the shape of the fact table; columns that are not given are null or plain defaults."""
    have = {"fact": F.lit(fact), "kind": F.lit("css"), "origin": F.lit("css"), "unit": F.lit(0), "seq": F.lit(0), "selector": F.lit(""), **columns}
    return rows.select(*[(have.get(n, F.lit(None))).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in FACTS.split(", "))])


def decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration for each line item."""
    n = F.col("l_linenumber") % 7
    prop = F.when(n == 1, "padding").when(n == 2, "margin-top").when(n == 3, "font-size").when(n == 4, "border-radius").when(n == 5, "color").when(n == 6, "background-color").otherwise("gap")
    tint = F.concat(F.lit("#"), F.substring(F.md5(F.col("l_partkey").cast("string").cast("binary")), 1, 6))
    value = F.when(n.isin(5, 6), tint).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("px")))
    return as_facts(table(spark, sf_dir, "lineitem"), "decl", file=F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string")), line=F.col("l_orderkey"), col=F.col("l_linenumber"), name=prop, value=value, id=F.col("l_suppkey"))


DECLS = """d AS (SELECT 'f' || CAST(l_orderkey % 97 AS VARCHAR) AS file, CAST(l_orderkey AS INTEGER) AS line, CAST(l_linenumber AS INTEGER) AS col, l_linestatus, l_returnflag, CAST(l_quantity AS INTEGER) AS q,
  CASE l_linenumber % 7 WHEN 1 THEN 'padding' WHEN 2 THEN 'margin-top' WHEN 3 THEN 'font-size' WHEN 4 THEN 'border-radius' WHEN 5 THEN 'color' WHEN 6 THEN 'background-color' ELSE 'gap' END AS name,
  CASE WHEN l_linenumber % 7 IN (5, 6) THEN '#' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 6) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'px' END AS value FROM lineitem)"""
SPACED = "(name IN ('padding', 'margin-top', 'gap') AND q NOT IN (4, 8, 12, 16, 24, 32))"
BAD = f"""v AS (
  SELECT 'no-arbitrary-spacing' AS rule_id, 'error' AS severity, * FROM d WHERE {SPACED}
  UNION ALL SELECT 'no-arbitrary-font-size', 'error', * FROM d WHERE name = 'font-size' AND q NOT IN (12, 14, 16, 18, 24)
  UNION ALL SELECT 'no-arbitrary-radius', 'warning', * FROM d WHERE name = 'border-radius' AND q NOT IN (4, 8, 12)
  UNION ALL SELECT 'no-hardcoded-color', 'error', * FROM d WHERE name IN ('color', 'background-color'))"""
PLAIN_RULES = ("no-arbitrary-spacing", "no-arbitrary-font-size", "no-arbitrary-radius", "no-hardcoded-color")


def plain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(decls(spark, sf_dir), CONFIG, {r: rules.RULES[r] for r in PLAIN_RULES})


@query(f"WITH {DECLS}, {BAD} SELECT rule_id, count(*) AS n FROM v GROUP BY rule_id")
def violations_by_rule(spark, sf_dir):
    return report.by_rule(plain_violations(spark, sf_dir))


@query(f"WITH {DECLS} SELECT file, line, col, name, value FROM d")
def decl_facts(spark, sf_dir):
    return decls(spark, sf_dir).select("file", "line", "col", "name", "value")


def one_rule(name: str):
    return lambda spark, sf_dir: rules.RULES[name](decls(spark, sf_dir), CONFIG).select("file", "line", "col", "old_value", "suggested")


def near_sql(scale: str, most: int) -> str:
    return f"(SELECT CAST(s AS VARCHAR) || 'px' FROM (SELECT unnest([{scale}]) AS s) WHERE abs(s - q) <= {most} ORDER BY abs(s - q), s LIMIT 1)"


for _name, _rule, _sql in (
    ("r2_spacing", "no-arbitrary-spacing", f"SELECT file, line, col, value AS old_value, CAST(NULL AS VARCHAR) AS suggested FROM d WHERE {SPACED}"),
    ("r3_font_size", "no-arbitrary-font-size", f"SELECT file, line, col, value AS old_value, {near_sql('12, 14, 16, 18, 24', 2)} AS suggested FROM d WHERE name = 'font-size' AND q NOT IN (12, 14, 16, 18, 24)"),
    ("r5_radius", "no-arbitrary-radius", f"SELECT file, line, col, value AS old_value, {near_sql('4, 8, 12', 2)} AS suggested FROM d WHERE name = 'border-radius' AND q NOT IN (4, 8, 12)"),
    ("x2_near_token", None, f"SELECT file, line, col, value AS old_value, {near_sql('4, 8, 12, 16, 24, 32', 4)} AS suggested FROM d WHERE {SPACED} AND {near_sql('4, 8, 12, 16, 24, 32', 4)} IS NOT NULL"),
):
    ORACLE[_name] = f"WITH {DECLS} {_sql}"
    if _rule:
        QUERIES[_name] = one_rule(_rule)


def x2_near_token(spark, sf_dir):
    return cross.near_spacing(decls(spark, sf_dir), TOKENS.spacing).select("file", "line", "col", "old_value", "suggested")


QUERIES["x2_near_token"] = x2_near_token


@query(f"""WITH {DECLS}, {BAD}, n AS (SELECT DISTINCT file, line, col, value FROM d WHERE {SPACED} AND {near_sql('4, 8, 12, 16, 24, 32', 4)} IS NOT NULL)
SELECT v.rule_id, v.file, v.line, v.col, v.value AS old_value FROM v LEFT JOIN n ON v.rule_id = 'no-arbitrary-spacing' AND v.file = n.file AND v.line = n.line AND v.col = n.col AND v.value = n.value WHERE n.file IS NULL""")
def x2_supersession(spark, sf_dir):
    found = decls(spark, sf_dir)
    return cross.supersede(plain_violations(spark, sf_dir), cross.near_spacing(found, TOKENS.spacing)).select("rule_id", "file", "line", "col", "old_value")


LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


def hex_sql(text: str, i: int) -> str:
    digit = lambda k: f"(strpos('0123456789abcdef', substr({text}, {k}, 1)) - 1)"
    return f"(({digit(2 + 2 * i)} * 16 + {digit(3 + 2 * i)}) / 255.0)"


def luminance_sql(text: str) -> str:
    return " + ".join(f"{w} * ({LIN.format(c=hex_sql(text, i))})" for i, w in enumerate((0.2126, 0.7152, 0.0722)))


def part_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style sheet for each part, rendered as text."""
    key = F.col("p_partkey").cast("string")
    tint = lambda salt: F.concat(F.lit("#"), F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, 6))
    text = F.concat(F.lit("/* part */\n.p"), key, F.lit(" {\n  color: "), tint("a"), F.lit("; background: url(x;y.png) no-repeat;\n  background-color: "), tint("b"), F.lit(";\n  font-family: '"), F.col("p_brand"), F.lit("', serif;\n  padding: "), F.col("p_size").cast("string"), F.lit("px 8px !important\n}\n"))
    return dealt(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit(".css")).alias("file"), text.alias("content"))


@query("""WITH p AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS k, * FROM part)
SELECT k || '.css' AS file, x.name, CASE x.name WHEN 'color' THEN '#' || substr(md5('a' || CAST(p_partkey AS VARCHAR)), 1, 6) WHEN 'background' THEN 'url(x;y.png) no-repeat' WHEN 'background-color' THEN '#' || substr(md5('b' || CAST(p_partkey AS VARCHAR)), 1, 6)
  WHEN 'font-family' THEN '''' || p_brand || ''', serif' ELSE CAST(p_size AS VARCHAR) || 'px 8px' END AS value, x.line, x.col, '.' || k AS selector
FROM p CROSS JOIN (VALUES ('color', 3, 3), ('background', 3, 19), ('background-color', 4, 3), ('font-family', 5, 3), ('padding', 6, 3)) AS x(name, line, col)""")
def p1_style_parser(spark, sf_dir):
    return facts.parse(part_styles(spark, sf_dir)).where("fact = 'decl'").select("file", "name", "value", "line", "col", "selector")


@query(f"""WITH p AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.css' AS file, '#' || substr(md5('a' || CAST(p_partkey AS VARCHAR)), 1, 6) AS x, '#' || substr(md5('b' || CAST(p_partkey AS VARCHAR)), 1, 6) AS y FROM part),
l AS (SELECT file, x, {luminance_sql('x')} AS lx, {luminance_sql('y')} AS ly FROM p)
SELECT file, 3 AS line, x AS old_value FROM l WHERE (greatest(lx, ly) + 0.05) / (least(lx, ly) + 0.05) < 4.5""")
def r6_contrast(spark, sf_dir):
    return rules.enforce_contrast(facts.parse(part_styles(spark, sf_dir)), CONFIG).select("file", "line", "old_value")


@query("SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.css' AS file, 5 AS line, p_brand AS old_value FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#33')")
def r4_font_family(spark, sf_dir):
    return rules.unauthorized_font_family(facts.parse(part_styles(spark, sf_dir)), CONFIG).select("file", "line", "old_value")


@query("""WITH c AS (SELECT 'f' || CAST(l_orderkey % 97 AS VARCHAR) AS file, CAST(l_orderkey AS INTEGER) AS line, CAST(l_quantity AS INTEGER) AS q, l_linenumber % 3 AS k FROM lineitem)
SELECT file, line, CASE k WHEN 0 THEN 'md:mt-[' WHEN 1 THEN 'hover:-p-[' ELSE 'rounded-[' END || CAST(q AS VARCHAR) || 'px]' AS old_value,
  CASE k WHEN 0 THEN 'md:mt-[' WHEN 1 THEN 'hover:-p-[' ELSE 'rounded-[' END || CASE WHEN k = 2 THEN """ + near_sql("4, 8, 12", 2) + " ELSE " + near_sql("4, 8, 12, 16, 24, 32", 4) + """ END || ']' AS suggested
FROM c WHERE CASE WHEN k = 2 THEN q NOT IN (4, 8, 12) ELSE q NOT IN (4, 8, 12, 16, 24, 32) END""")
def r7_utility_classes(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    head = F.when(k == 0, "md:mt-[").when(k == 1, "hover:-p-[").otherwise("rounded-[")
    text = F.concat(F.lit("flex "), head, F.col("l_quantity").cast("int").cast("string"), F.lit("px] w-[calc(1px+2px)]"))
    found = as_facts(table(spark, sf_dir, "lineitem"), "class", file=F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string")), line=F.col("l_orderkey"), col=F.col("l_linenumber"), value=text)
    return rules.tailwind_arbitrary(found, CONFIG).select("file", "line", "old_value", "suggested")


@query("SELECT CAST(l_quantity AS INTEGER) AS q, (SELECT CAST(s AS DOUBLE) FROM (SELECT unnest([4, 8, 12, 16, 24, 32]) AS s) WHERE abs(s - l_quantity) <= 4 ORDER BY abs(s - l_quantity), s LIMIT 1) AS near FROM (SELECT DISTINCT l_quantity FROM lineitem)")
def f5_nearest(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select("l_quantity").distinct()
    return q.select(F.col("l_quantity").cast("int").alias("q"), values.nearest(F.col("l_quantity"), TOKENS.spacing, 4).alias("near"))


def _delta_sql(key: str = "p_partkey", source: str = "part") -> str:
    """Distances s8(value, token, ord, de) of the tints of a table's keys from all tokens."""

    def lab(h: str, p: str) -> str:
        return f"{LIN.format(c=hex_sql(h, 0))} AS {p}r, {LIN.format(c=hex_sql(h, 1))} AS {p}g, {LIN.format(c=hex_sql(h, 2))} AS {p}bl"

    def curve(p: str, k: int) -> str:
        t = "(" + " + ".join(f"{p}{c} * {m}" for c, m in zip(("r", "g", "bl"), color.TO_XYZ[k], strict=True)) + f") / {color.WHITE[k]}"
        return f"CASE WHEN {t} > 216.0 / 24389 THEN cbrt({t}) ELSE (24389.0 / 27 * ({t}) + 16) / 116 END"

    labs = ", ".join(f"116 * ({curve(p, 1)}) - 16 AS {p}l, 500 * (({curve(p, 0)}) - ({curve(p, 1)})) AS {p}a, 200 * (({curve(p, 1)}) - ({curve(p, 2)})) AS {p}b" for p in "vt")
    tokens = ", ".join(f"({i}, '{n}', '{v}')" for i, (n, v) in enumerate(TOKENS.colors.items()))
    hue = lambda b, a: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE (degrees(atan2({b}, {a})) + 360) % 360 END"
    return f"""WITH c AS (SELECT DISTINCT '#' || substr(md5(CAST({key} AS VARCHAR)), 1, 6) AS value FROM {source}), colors(ord, token, hex) AS (VALUES {tokens}),
s0 AS (SELECT value, token, ord, hex, {lab('value', 'v')}, {lab('hex', 't')} FROM c CROSS JOIN colors),
s1 AS (SELECT value, token, ord, hex, {labs} FROM s0),
s2 AS (SELECT *, pow((sqrt(va * va + vb * vb) + sqrt(ta * ta + tb * tb)) / 2, 7) AS m7 FROM s1),
s3 AS (SELECT *, (1 + 0.5 * (1 - sqrt(m7 / (m7 + 6103515625)))) * va AS a1, (1 + 0.5 * (1 - sqrt(m7 / (m7 + 6103515625)))) * ta AS a2 FROM s2),
s4 AS (SELECT *, sqrt(a1 * a1 + vb * vb) AS c1, sqrt(a2 * a2 + tb * tb) AS c2, {hue('vb', 'a1')} AS h1, {hue('tb', 'a2')} AS h2 FROM s3),
s5 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS turn,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (vl + tl) / 2 AS lm, (c1 + c2) / 2 AS cm FROM s4),
s6 AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS tt,
  -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625)) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) AS rt FROM s5),
s7 AS (SELECT *, (tl - vl) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS dl, (c2 - c1) / (1 + 0.045 * cm) AS dc, 2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015 * cm * tt) AS dh FROM s6),
s8 AS (SELECT value, token, ord, CASE WHEN value = hex THEN -1 ELSE sqrt(dl * dl + dc * dc + dh * dh + rt * dc * dh) END AS de FROM s7)
"""


@query(_delta_sql() + "SELECT value, token FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY de, ord) AS k FROM s8 WHERE de <= 10) WHERE k = 1")
def f7_nearest_color(spark, sf_dir):
    tint = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 6))
    return rules.closest_colors(table(spark, sf_dir, "part").select(tint.alias("value")), TOKENS.colors)


@query(_delta_sql() + "SELECT value, token, round(de, 4) AS de FROM s8 WHERE de >= 0")
def f8_color_distance(spark, sf_dir):
    tint = F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 6))
    mine = color.with_lab(table(spark, sf_dir, "part").select(tint.alias("value")).distinct(), "value", "v")
    dim = color.with_lab(spark.createDataFrame(list(TOKENS.colors.items()), "token string, hex string"), "hex", "t")
    pairs = color.with_delta_e(mine.join(F.broadcast(dim)).where("value <> hex"), "v", "t", "d")
    return pairs.select("value", "token", F.round("d", 4).alias("de"))


@query("SELECT '--p' || CAST(p_partkey AS VARCHAR) AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 3 AND l_quantity < 9)")
def x1_dead_token(spark, sf_dir):
    defined = as_facts(table(spark, sf_dir, "part"), "decl", file=F.lit("t.css"), line=F.col("p_partkey"), col=F.lit(1), name=F.concat(F.lit("--p"), F.col("p_partkey").cast("string")), value=F.lit("1px"), selector=F.lit(":root "))
    used = as_facts(table(spark, sf_dir, "lineitem").where("l_linenumber = 3 and l_quantity < 9"), "decl", file=F.lit("u.css"), line=F.col("l_orderkey"), col=F.lit(1), name=F.lit("width"), value=F.concat(F.lit("calc(1px + var( --p"), F.col("l_partkey").cast("string"), F.lit("))")))
    return cross.dead_tokens(defined.unionByName(used)).select(F.regexp_extract("message", r"^(\S+)", 1).alias("name"))


@query("""WITH c AS (SELECT replace(p_name, ' ', '') AS key, p_name AS name, list_sort(list(DISTINCT p_brand)) AS props, list_sort(list(DISTINCT p_type)) AS structure FROM part GROUP BY p_name),
p AS (SELECT a.key AS key_a, b.key AS key_b, CASE WHEN lower(a.name) = lower(b.name) THEN 1.0 ELSE 1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)) END AS ns,
  len(list_intersect(a.props, b.props)) / len(list_distinct(list_concat(a.props, b.props))) AS ps, len(list_intersect(a.structure, b.structure)) / len(list_distinct(list_concat(a.structure, b.structure))) AS ss FROM c a JOIN c b ON a.key < b.key)
SELECT key_a, key_b, round(0.3 * ns + 0.35 * ps + 0.35 * ss, 6) AS score FROM p WHERE 0.3 * ns + 0.35 * ps + 0.35 * ss >= 0.75 AND ns >= 0.5""")
def x3_variant_sprawl(spark, sf_dir):
    found = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("props"), F.collect_set("p_type").alias("structure")).withColumn("key", F.regexp_replace("name", " ", ""))
    return cross.similar_pairs(found).select("key_a", "key_b", F.round("score", 6).alias("score"))


@query(f"""WITH {DECLS}, {BAD} SELECT rule_id, file, line, col, value AS old_value FROM v WHERE NOT (line % 5 = 0 AND (line % 2 = 0 OR rule_id = 'no-arbitrary-spacing'))""")
def i3_suppress(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string")).alias("file"), F.col("l_orderkey").cast("int").alias("line")).distinct().where("line % 5 = 0")
    targets = keys.select("file", "line", (F.col("line") % 2 == 0).alias("all_rules"), F.array(F.lit("no-arbitrary-spacing")).alias("ids"))
    return suppress.apply(plain_violations(spark, sf_dir), targets).select("rule_id", "file", "line", "col", "old_value")


def simple_violations(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Line items as violations whose equal keys agree on every column."""
    rows = table(spark, sf_dir, "lineitem").where(where)
    return rows.select(F.concat(F.lit("r"), (F.col("l_linenumber") % 4).cast("string")).alias("rule_id"), F.when(F.col("l_linenumber") % 2 == 0, "error").otherwise("warning").alias("severity"), F.concat(F.lit("m"), (F.col("l_partkey") % 11).cast("string")).alias("message"), F.concat(F.lit("/app/f"), (F.col("l_orderkey") % 97).cast("string")).alias("file"), F.col("l_orderkey").cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("col"), F.lit(None).cast("string").alias("suggested"), F.lit(None).cast("string").alias("old_value"))


def simple_sql(where: str = "true") -> str:
    return f"(SELECT 'r' || CAST(l_linenumber % 4 AS VARCHAR) AS rule_id, CASE WHEN l_linenumber % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, 'm' || CAST(l_partkey % 11 AS VARCHAR) AS message, 'f' || CAST(l_orderkey % 97 AS VARCHAR) AS file, l_orderkey AS line, l_linenumber AS col FROM lineitem WHERE {where})"


PRINT = "sha1(rule_id || chr(0) || file || chr(0) || message || chr(0) || CAST(row_number() OVER (PARTITION BY rule_id, file, message ORDER BY line, col) - 1 AS VARCHAR))"
OLD, NEW = "l_returnflag = 'N'", "l_returnflag <> 'A'"


@query(f"SELECT rule_id, file AS rel_file, message, {PRINT} AS fingerprint FROM {simple_sql()}")
def b1_fingerprint(spark, sf_dir):
    return baseline.fingerprinted(simple_violations(spark, sf_dir), "/app").select("rule_id", "rel_file", "message", "fingerprint")


@query(f"WITH n AS (SELECT *, {PRINT} AS fingerprint FROM {simple_sql(NEW)}), o AS (SELECT {PRINT} AS fingerprint FROM {simple_sql(OLD)}) SELECT rule_id, message, fingerprint FROM n WHERE fingerprint NOT IN (SELECT fingerprint FROM o)")
def b2_apply_baseline(spark, sf_dir):
    stored = baseline.entries(simple_violations(spark, sf_dir, OLD), "/app")
    return baseline.apply(simple_violations(spark, sf_dir, NEW), stored, "/app").select("rule_id", "message", "fingerprint")


@query(f"WITH n AS (SELECT {PRINT} AS f FROM {simple_sql(NEW)}), o AS (SELECT {PRINT} AS f FROM {simple_sql(OLD)}) SELECT (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM n WHERE f IN (SELECT f FROM o)) AS baselined, (SELECT count(*) FROM n WHERE f NOT IN (SELECT f FROM o)) AS new, (SELECT count(*) FROM o WHERE f NOT IN (SELECT f FROM n)) AS resolved, (SELECT count(*) FROM o) AS baseline_total")
def b2_counts(spark, sf_dir):
    return baseline.counts(simple_violations(spark, sf_dir, NEW), baseline.entries(simple_violations(spark, sf_dir, OLD), "/app"), "/app")


@query(f"WITH n AS (SELECT {PRINT} AS f FROM {simple_sql(OLD)}), o AS (SELECT *, {PRINT} AS f FROM {simple_sql(NEW)}) SELECT f AS fingerprint, rule_id AS ruleId, file FROM o WHERE f IN (SELECT f FROM n)")
def b4_prune(spark, sf_dir):
    stored = baseline.entries(simple_violations(spark, sf_dir, NEW), "/app")
    return baseline.prune(stored, simple_violations(spark, sf_dir, OLD), "/app").select("fingerprint", "ruleId", "file")


BASE_SIDE, HEAD_SIDE = "l_linestatus = 'O' AND l_quantity < 30", "l_linestatus = 'F' AND l_quantity < 25"
ONLY = "SELECT DISTINCT a.rule_id, '/app/' || a.file AS file, a.message FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE a.rule_id = b.rule_id AND a.file = b.file AND a.message = b.message)"


@query(ONLY.format(a=simple_sql(HEAD_SIDE), b=simple_sql(BASE_SIDE)))
def b6_diff_new(spark, sf_dir):
    return diff.only_in(simple_violations(spark, sf_dir, HEAD_SIDE), simple_violations(spark, sf_dir, BASE_SIDE)).select(*diff.KEY)


@query(ONLY.format(a=simple_sql(BASE_SIDE), b=simple_sql(HEAD_SIDE)))
def b6_diff_fixed(spark, sf_dir):
    return diff.only_in(simple_violations(spark, sf_dir, BASE_SIDE), simple_violations(spark, sf_dir, HEAD_SIDE)).select(*diff.KEY)


@query(f"SELECT '/app/' || file AS file, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM (SELECT file, count(*) AS before FROM {simple_sql(BASE_SIDE)} GROUP BY file) FULL JOIN (SELECT file, count(*) AS after FROM {simple_sql(HEAD_SIDE)} GROUP BY file) USING (file) WHERE coalesce(after, 0) <> coalesce(before, 0)")
def b6_file_impact(spark, sf_dir):
    return diff.file_impact(simple_violations(spark, sf_dir, BASE_SIDE), simple_violations(spark, sf_dir, HEAD_SIDE))


@query(f"""WITH n AS (SELECT DISTINCT x.rule_id, x.file, x.message, b.severity FROM ({ONLY.format(a=simple_sql(HEAD_SIDE), b=simple_sql(BASE_SIDE))}) x JOIN (SELECT DISTINCT rule_id, severity FROM {simple_sql()}) b USING (rule_id)), f AS ({ONLY.format(a=simple_sql(BASE_SIDE), b=simple_sql(HEAD_SIDE))})
SELECT count(*) FILTER (severity = 'error') AS new_errors, count(*) FILTER (severity = 'warning') AS new_warnings, count(*) AS new, (SELECT count(*) FROM f) AS fixed, (SELECT count(*) FROM {simple_sql(HEAD_SIDE)}) - (SELECT count(*) FROM {simple_sql(BASE_SIDE)}) AS net_change,
  CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'blocking' WHEN count(*) FILTER (severity = 'warning') > 5 THEN 'needs-attention' ELSE 'pass' END AS verdict FROM n""")
def b6_diff_verdict(spark, sf_dir):
    return diff.summary(simple_violations(spark, sf_dir, BASE_SIDE), simple_violations(spark, sf_dir, HEAD_SIDE))


USE = f"""{DECLS}, u AS (SELECT CASE WHEN name IN ('color', 'background-color') THEN 'color' WHEN name = 'font-size' THEN 'fontSize' WHEN name = 'border-radius' THEN 'radius' ELSE 'spacing' END AS category, CASE WHEN name IN ('color', 'background-color') THEN value ELSE CAST(q AS VARCHAR) END AS value, count(*) AS n FROM d GROUP BY 1, 2)"""
TOKEN_ROWS = "t(category, value) AS (VALUES " + ", ".join([f"('color', '{v}')" for v in TOKENS.colors.values()] + [f"('spacing', '{v}')" for v in TOKENS.spacing] + [f"('fontSize', '{v}')" for v in TOKENS.font_sizes] + [f"('radius', '{v}')" for v in TOKENS.radii] + [f"('fontFamily', '{v.lower()}')" for v in TOKENS.font_families]) + ")"


@query(f"WITH {USE} SELECT category, value, n FROM u")
def g1_usage(spark, sf_dir):
    return extract.usage(decls(spark, sf_dir))


@query(f"WITH {USE} SELECT category, value, n FROM u WHERE n >= 2")
def g2_used_twice(spark, sf_dir):
    return extract.at_least(extract.usage(decls(spark, sf_dir)))


@query(f"WITH {USE}, {TOKEN_ROWS} SELECT category, value, n FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.category = u.category AND t.value = u.value)")
def b8_drifted(spark, sf_dir):
    return drift.drifted(drift.code_values(decls(spark, sf_dir)), TOKENS).select("category", "value", "n")


CLOSEST = "closest AS (SELECT value, token FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY de, ord) AS k FROM s8 WHERE de <= 10) WHERE k = 1)"


def reach_sql(category: str) -> str:
    """The nearest value of the category's scale to the number q within its reach."""
    scale, most = {"spacing": (TOKENS.spacing, 4), "fontSize": (TOKENS.font_sizes, 2), "radius": (TOKENS.radii, 2)}[category]
    return near_sql(", ".join(map(str, scale)), most)


@query(
    _delta_sql("l_partkey", "lineitem") + f", {CLOSEST}, {USE}, {TOKEN_ROWS}, o AS (SELECT *, try_cast(value AS INTEGER) AS q FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.category = u.category AND t.value = u.value)) "
    f"SELECT category, o.value, n, CASE category WHEN 'color' THEN token WHEN 'spacing' THEN {reach_sql('spacing')} WHEN 'fontSize' THEN {reach_sql('fontSize')} ELSE {reach_sql('radius')} END AS nearest FROM o LEFT JOIN closest ON category = 'color' AND o.value = closest.value"
)
def b8_nearest(spark, sf_dir):
    return drift.drifted(drift.code_values(decls(spark, sf_dir)), TOKENS).select("category", "value", "n", "nearest")


@query(f"WITH {USE}, {TOKEN_ROWS} SELECT category, value FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE t.category = u.category AND t.value = u.value)")
def b8_unused(spark, sf_dir):
    return drift.unused(drift.code_values(decls(spark, sf_dir)), TOKENS).select("category", "value")


@query(f"WITH {USE}, {TOKEN_ROWS}, s AS (SELECT count(*) AS unique_values, count(*) FILTER (t.value IS NULL) AS drifted FROM u LEFT JOIN t ON t.category = u.category AND t.value = u.value) SELECT unique_values, drifted, (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE t.category = u.category AND t.value = u.value)) AS unused, round(drifted * 100 / unique_values, 6) AS drift_percent FROM s")
def b8_summary(spark, sf_dir):
    return drift.summary(drift.code_values(decls(spark, sf_dir)), TOKENS).select("unique_values", "drifted", "unused", F.round("drift_percent", 6).alias("drift_percent"))


@query(f"WITH {DECLS}, {BAD} SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT file) AS files FROM v")
def g6_summary(spark, sf_dir):
    return report.check_summary(plain_violations(spark, sf_dir)).select("total", "errors", "warnings", "files")


@query("""SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS file FROM orders WHERE o_orderkey % 6 IN (0, 2, 4)""")
def r18_todo(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, "todo: tidy up").when(k == 1, "TODO(#12) tidy up").when(k == 2, "FIXME later").when(k == 3, "a note").when(k == 4, "TODO [cleanup]").otherwise("TODO [AB-1]")
    return rules.todo_without_ticket(as_facts(table(spark, sf_dir, "orders"), "comment", file=F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), line=F.lit(1), col=F.lit(1), value=text), CONFIG).select("file")


@query("""SELECT file, count(*) AS n FROM (SELECT 'd' || CAST(doc_id AS VARCHAR) AS file, unnest(regexp_extract_all(text, '(?i)\\b(?:password|passwd|secret|api_?key|auth_?token|access_?token|private_?key|token)["'']?\\s*[:=]\\s*["''`]([^"''`\\s]{8,})["''`]', 1)) AS hit FROM documents) GROUP BY file""")
def r17_credentials(spark, sf_dir):
    found = as_facts(table(spark, sf_dir, "documents"), "source", file=F.concat(F.lit("d"), F.col("doc_id").cast("string")), line=F.lit(1), col=F.lit(0), value=F.col("text"))
    return rules.hardcoded_credentials(found, CONFIG).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


SNIPPETS = {
    0: "export function Card({ title, tone }) {\n  return <img src={title} />;\n}\n",
    1: "const Bar = (props) => {\n  return <div onClick={props.go} style={{ padding: 13, color: '#ff0000' }}>x</div>;\n};\n",
    2: "export default function Ask() {\n  console.log('hi'); console.warn(authToken);\n  return <button><span /></button>;\n}\n",
    3: "export const Field = () => <input type=\"text\" autoFocus tabIndex={3} />;\n",
    4: "function Html({ html }) {\n  const key = process.env.SECRET_KEY;\n  return <p dangerouslySetInnerHTML={{ __html: html }} />;\n}\n",
    5: "// TODO remove\nconst n = load(42) * 7;\nfunction Empty() { return <button></button>; }\n",
    6: "function Safe() {\n  console.log('x'); // eslint-disable-line\n  return <img alt=\"\" /> || <p dangerouslySetInnerHTML={{ __html: sanitize(x) }} />;\n}\n",
}
EXPECTED = {
    0: ["no-img-without-alt"],
    1: ["no-div-button", "no-inline-styles", "no-hardcoded-color"],
    2: ["no-console-log", "no-console-sensitive"],
    3: ["no-missing-form-label", "no-autofocus", "no-positive-tabindex"],
    4: ["no-env-in-client", "no-xss-dangerous"],
    5: ["no-todo-without-ticket", "no-magic-numbers", "no-magic-numbers", "no-empty-button"],
    6: [],
}


@query("WITH e(k, rule_id) AS (VALUES " + ", ".join(f"({k}, '{r}')" for k, rs in EXPECTED.items() for r in rs) + ") SELECT rule_id, count(*) AS n FROM orders JOIN e ON o_orderkey % 7 = k GROUP BY rule_id")
def component_rules(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    text = F.lit("")
    for i, s in SNIPPETS.items():
        text = F.when(k == i, s).otherwise(text)
    files = dealt(spark, sf_dir, "orders").select(F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".tsx")).alias("file"), text.alias("content"))
    return report.by_rule(rules.apply(facts.stored(facts.parse(files)), CONFIG))


BROKEN = {
    0: (".a { padding: 13px; color: #abc", "Unclosed block"),
    1: (".a { padding: 13px }} .b { gap: 2px }", "Unexpected }"),
    2: (".a { padding: 13px } /* open .b { gap: 1px }", "Unclosed comment"),
    3: (".a { content: \"x; gap: 1px } .b { gap: 2px }", "Unclosed string"),
}


def chosen(key, texts: dict, rest: str = ""):
    """The text of each key, and the rest for keys without one."""
    out = F.lit(rest)
    for k, text in texts.items():
        out = F.when(key == k, text).otherwise(out)
    return out


@query("WITH b(k, error) AS (VALUES " + ", ".join(f"({k}, '{e}')" for k, (_, e) in BROKEN.items()) + ") SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.css' AS file, CASE WHEN error IS NULL THEN 2 ELSE 0 END AS declarations, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS others, error FROM part LEFT JOIN b ON p_partkey % 9 = k")
def p11_parse_errors(spark, sf_dir):
    """Style sheets of which four in nine are broken: these give their error and no other fact."""
    text = chosen(F.col("p_partkey") % 9, {k: t for k, (t, _) in BROKEN.items()}, ".a { padding: 13px; content: '}' }")
    files = dealt(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".css")).alias("file"), text.alias("content"))
    found = facts.parse(files).groupBy("file").agg(F.count_if(F.col("fact") == "decl").cast("int").alias("declarations"), F.count_if(F.col("fact") != "decl").cast("int").alias("others"), F.max(F.when(F.col("fact") == "error", F.col("value"))).alias("error"))
    return found


LOGS = {
    0: ("console.log('token', a, 1);", None),
    1: ("console.error(\n  'x',\n  user.password);", "password"),
    2: ("console.log(`x ${`in ${b.apiKey}`} ${token}`);", "apiKey"),
    3: ("console.log(a), foo(password); console.log(session.id);", None),
    4: ("console.log({ a: token, 'api_key': 1 });", "api_key"),
    5: ("foo(() => console.warn((authToken), bar(secret)));", "authToken"),
    6: ("console.log({ a: { token } }, [session], a + token, a.token());", None),
    7: ("console.debug(a[credentials]);", "credentials"),
}


@query("WITH e(k, word) AS (VALUES " + ", ".join(f"({k}, '{w}')" for k, (_, w) in LOGS.items() if w) + ") SELECT 'src/o' || CAST(o_orderkey AS VARCHAR) || '.tsx' AS file, 1 + CAST(o_orderkey % 3 AS INTEGER) AS line, '\"' || word || '\" is logged' AS message FROM orders JOIN e ON o_orderkey % 9 = k")
def r16_console_sensitive(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat(F.repeat(F.lit("\n"), (key % 3).cast("int")), chosen(key % 9, {k: t for k, (t, _) in LOGS.items()}, "no.call(token);"))
    files = dealt(spark, sf_dir, "orders").select(F.concat(F.lit("src/o"), key.cast("string"), F.lit(".tsx")).alias("file"), text.alias("content"))
    return rules.console_sensitive(facts.parse(files), CONFIG).select("file", "line", "message")


@query("SELECT 'p' || CAST(page_id AS VARCHAR) || '.twig' AS file, len(regexp_extract_all(html, '<div class=\"ad\">')) AS n FROM pages")
def p9_tag_scan(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".twig")).alias("file"), F.col("html").alias("content"))
    return facts.parse(files).where("fact = 'class'").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE event_id % 6 WHEN 0 THEN 'jsx' WHEN 1 THEN 'angular' WHEN 2 THEN 'blade' WHEN 3 THEN 'scss' ELSE NULL END AS kind, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def s2_dispatch(spark, sf_dir):
    k = F.col("event_id") % 6
    name = F.when(k == 0, "A.TSX").when(k == 1, "a.component.ts").when(k == 2, "v.blade.php").when(k == 3, "s.module.scss").when(k == 4, "a.ts").otherwise("index.html")
    path = F.concat(F.when(F.col("event_id") % 7 == 0, "src/node_modules/x/").otherwise("src/x/"), name)
    files = table(spark, sf_dir, "events").select(path.alias("file"))
    from inkstone.sources.files import not_ignored

    return not_ignored(files).select(kind_of(F.col("file")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT DISTINCT ts FROM events), g AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) >= 600 THEN ts END AS s FROM t),
b AS (SELECT ts, max(s) OVER (ORDER BY ts) AS burst FROM g), e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS path, event_id, burst, row_number() OVER (PARTITION BY user_id, burst ORDER BY events.ts DESC, event_id DESC) AS k FROM events JOIN b USING (ts))
SELECT path, event_id AS seq FROM e WHERE k = 1""")
def t2_debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    changes = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.lit("change").alias("type"), F.col("event_type").alias("content"), "ts", F.col("event_id").alias("seq"))
    return watch.debounce(changes, 600).select("path", "seq")


@query("SELECT 'u' || CAST(user_id AS VARCHAR) || '.css' AS file, '.e' || CAST(max_by(event_id, struct_pack(a := ts, b := event_id)) AS VARCHAR) AS selector FROM events GROUP BY user_id HAVING max_by(event_id, struct_pack(a := ts, b := event_id)) % 5 <> 0")
def t3_incremental(spark, sf_dir):
    """Two halves of the events as batches of changes on the fact table; every fifth event removes its file."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit(".e"), F.col("event_id").cast("string"), F.lit(" { padding: 13px }"))
    changes = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".css")).alias("path"), F.when(F.col("event_id") % 5 == 0, "unlink").otherwise("change").alias("type"), text.alias("content"), "ts", F.col("event_id").alias("seq"))
    cut = e.agg(F.percentile_approx("ts", 0.5)).first()[0]
    state = spark.createDataFrame([], FACTS)
    for half in (changes.where(F.col("ts") <= F.lit(cut)), changes.where(F.col("ts") > F.lit(cut))):
        state = watch.updated(state, half)
    return state.where("fact = 'decl'").select("file", "selector")


def events_as_changes(spark: SparkSession, sf_dir: str):
    """Every event sets the style sheet of its user, of whose texts there are 40, or removes it; cut into four batches by time."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    text = F.concat(F.lit(":root { --t"), (n % 10).cast("string"), F.lit(": 1px } .a { width: var(--t"), (n % 8).cast("string"), F.lit(") }"))
    user, first = F.col("user_id"), e.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("a"), (F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) + 1).alias("z")).first()
    changes = e.select(F.concat(F.lit("u"), user.cast("string"), F.lit(".css")).alias("path"), F.when(n % 5 == 0, "unlink").otherwise("change").alias("type"), text.alias("content"), "ts", n.alias("seq"))
    part = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - first["a"]) * 4 / (first["z"] - first["a"])).cast("int")
    return [changes.where(part == k) for k in range(4)]


QUARTERS = """q AS (SELECT *, CAST(floor((floor(epoch(ts)) - a) * 4 / (z - a)) AS INTEGER) AS part FROM events, (SELECT min(floor(epoch(ts))) AS a, max(floor(epoch(ts))) + 1 AS z FROM events))"""


@query(f"""WITH {QUARTERS}, l AS (SELECT user_id, part, max_by(event_id, struct_pack(a := ts, b := event_id)) AS e FROM q GROUP BY user_id, part), f AS (SELECT e % 40 AS text, min(part) AS part FROM l WHERE e % 5 <> 0 GROUP BY 1)
SELECT CAST(part + 1 AS VARCHAR) AS batch, count(*) AS parsed FROM f GROUP BY 1""")
def t4_memo(spark, sf_dir):
    """How many texts each batch of changes had to parse: the files change far more often."""
    store = scratch_folder(spark, "memo")
    for number, changes in enumerate(events_as_changes(spark, sf_dir), 1):
        fresh = watch.latest(changes).where("type = 'change'").select(F.col("path").alias("file"), "content")
        memo.parse(fresh, store, str(number))
    return memo.parsed_texts(spark, store)


@query("""WITH l AS (SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS e FROM events GROUP BY user_id), s AS (SELECT * FROM l WHERE e % 5 <> 0)
SELECT 'u' || CAST(user_id AS VARCHAR) || '.css' AS file, '--t' || CAST(e % 10 AS VARCHAR) || ' is never used' AS message FROM s WHERE e % 10 NOT IN (SELECT e % 8 FROM s)""")
def x1_watched(spark, sf_dir):
    """Unused tokens after four batches on the stored fact table, from counts that each batch only corrects."""
    store = scratch_folder(spark, "facts")
    for changes in events_as_changes(spark, sf_dir):
        watch.apply_batch(spark, store, changes)
    return watch.dead_tokens(spark, store).select("file", "message")


@query()
def g14_clusters(spark, sf_dir):
    used = extract.usage(decls(spark, sf_dir)).where("category = 'color'")
    return extract.clusters(used.select("value", "n"))


@query("WITH p AS (SELECT p_size FROM part) SELECT CASE WHEN near IS NULL THEN 'skipped' ELSE 'applied' END AS status, count(*) AS n FROM (SELECT (SELECT s FROM (SELECT unnest([12, 14, 16, 18, 24]) AS s) WHERE abs(s - p_size) <= 2 ORDER BY abs(s - p_size), s LIMIT 1) AS near FROM p WHERE p_size NOT IN (12, 14, 16, 18, 24)) GROUP BY 1")
def b11_fixes(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    files = dealt(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit(".css")).alias("file"), F.concat(F.lit(".a { font-size: "), F.col("p_size").cast("string"), F.lit("px }")).alias("content"))
    found = rules.arbitrary_font_size(facts.parse(files), CONFIG)
    return fix.apply(found, files).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT p_size FROM part) SELECT CASE WHEN near IS NULL THEN 'no-fix' END AS reason, count(*) AS n FROM (SELECT (SELECT s FROM (SELECT unnest([12, 14, 16, 18, 24]) AS s) WHERE abs(s - p_size) <= 2 ORDER BY abs(s - p_size), s LIMIT 1) AS near FROM p WHERE p_size NOT IN (12, 14, 16, 18, 24)) GROUP BY 1")
def b11_reasons(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    files = dealt(spark, sf_dir, "part").select(F.concat(F.lit("p"), key, F.lit(".css")).alias("file"), F.concat(F.lit(".a { font-size: "), F.col("p_size").cast("string"), F.lit("px }")).alias("content"))
    return fix.summary(fix.apply(rules.arbitrary_font_size(facts.parse(files), CONFIG), files)).select("reason", "n")


VARIABLES = ("src/tokens.css", "styles/_variables.scss", "css/app.css", "src/other.css", "tokens.scss", "index.css")


@query("WITH f(k, file, place) AS (VALUES " + ", ".join(f"({k}, '{f}', {tokens.variable_files().index(f) if f in tokens.variable_files() else 'NULL'})" for k, f in enumerate(VARIABLES)) + """), v AS (SELECT file, place, '--v' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS VARCHAR) || 'px' AS value FROM part JOIN f ON k = p_partkey % 6 WHERE place IS NOT NULL),
b AS (SELECT place FROM v GROUP BY place HAVING count(*) >= 3 ORDER BY count(*) DESC, place LIMIT 1) SELECT file, name, value FROM v JOIN b USING (place)""")
def s16_variable_file(spark, sf_dir):
    file = chosen(F.col("p_partkey") % 6, dict(enumerate(VARIABLES)))
    found = as_facts(table(spark, sf_dir, "part"), "decl", file=F.concat(F.lit("/app/"), file), name=F.concat(F.lit("--v"), F.col("p_partkey").cast("string")), value=F.concat(F.col("p_size").cast("string"), F.lit("px")), selector=F.lit(":root"))
    return tokens.best_variables(found, "/app").select(F.regexp_replace("file", "^/app/", "").alias("file"), "name", "value")


def _sarif_sql() -> str:
    place = {r[0]: i for i, r in enumerate(rules.CATALOG)}
    index = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {place[r]}" for r in PLAIN_RULES) + " END"
    said = """CASE rule_id WHEN 'no-arbitrary-spacing' THEN '"' || v.value || '" in ' || name || ' is not on the spacing scale' WHEN 'no-arbitrary-font-size' THEN 'Font size "' || v.value || '" is not on the scale'
  WHEN 'no-arbitrary-radius' THEN 'Radius "' || v.value || '" is not on the scale' ELSE 'Hard-coded colour "' || v.value || '" in ' || name END"""
    mended = f"CASE rule_id WHEN 'no-arbitrary-font-size' THEN {reach_sql('fontSize')} WHEN 'no-arbitrary-radius' THEN {reach_sql('radius')} WHEN 'no-hardcoded-color' THEN 'var(' || token || ')' END"
    text = f"{said} || coalesce(' (fix: ' || {mended} || ')', '')"
    where = "json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file), 'region', json_object('startLine', greatest(line, 1), 'startColumn', greatest(col, 1))))"
    return f"""{_delta_sql("l_partkey", "lineitem")}, {CLOSEST}, {DECLS}, {BAD}
SELECT file, line, col, CAST(json_object('ruleId', rule_id, 'ruleIndex', {index}, 'level', severity, 'message', json_object('text', {text}), 'locations', json_array({where})) AS VARCHAR) AS result
FROM v LEFT JOIN closest ON rule_id = 'no-hardcoded-color' AND v.value = closest.value"""


@query(_sarif_sql())
def k3_sarif(spark, sf_dir):
    return report.sarif_results(plain_violations(spark, sf_dir)).select("file", "line", "col", "result")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations_by_rule(spark, sf_dir)
