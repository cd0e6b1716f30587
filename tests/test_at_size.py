"""What keeps the work of a query in proportion to its input, and results the same by another way."""

import random

from pyspark.sql import functions as F

from inkstone.functions import color
from inkstone.operators import drift, extract, facts, fix, rules
from inkstone.schema import VIOLATIONS
from inkstone.sources.config import Config, Tokens
from inkstone.streaming import watch


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixes_take_files_in_batches(spark):
    rows = [("r", "error", "m", f, line, col, new, old) for f, line, col, old, new in (("a", 2, 1, "9px", "8px"), ("a", 1, 6, "5px", "4px"), ("a", 1, 1, "5px", None), ("gone", 1, 1, "x", "y"), ("none", 1, 1, "x", "y"))]
    sources = spark.createDataFrame([("a", "w: 5px 5px\nh: 9px"), ("none", None), ("clean", "x")], "file string, content string")
    fixes = fix.apply(spark.createDataFrame(rows, VIOLATIONS).repartition(3), sources)
    assert "InPandas" not in plan_of(fixes)  # one call of Python for each file took 8 ms a file
    got = [(r.file, r.line, r.col, r.status, r.reason, r.content) for r in fixes.orderBy("file", "line", "col").collect()]
    assert got == [
        ("a", 1, 1, "skipped", "no-fix", "w: 5px 4px\nh: 8px"), ("a", 1, 6, "applied", None, None), ("a", 2, 1, "applied", None, None),
        ("gone", 1, 1, "skipped", "file-read-error", None), ("none", 1, 1, "skipped", "file-read-error", None),
    ]


def test_declarations_are_taken_apart_once(spark):
    rows = [("a.css", f".a {{ color: {c}; padding: 13px 5px / 5px; font-family: '{f}', x; border-radius: 4px }}") for c, f in (("RED", "Inter"), ("#f00", "inter"), ("red", "serif"), ("var(--x)", "Arial"))] * 5
    parsed = facts.parse(spark.createDataFrame(rows, "file string, content string")).persist()
    each = extract.occurrences(parsed, drift.KINDS, skip_tokens=True)
    want = {(r.category, r.value): r["count"] for r in each.groupBy("category", "value").count().collect()}
    got = {(r.category, r.value): r.n for r in extract.counted(parsed, drift.KINDS, skip_tokens=True).groupBy("category", "value").agg(F.sum("n").alias("n")).collect()}
    assert got == want and want[("color", "#ff0000")] == 5 and want[("spacing", "5")] == 40
    codes = drift.code_values(parsed)
    assert {(r.value, r.shown, r.n) for r in codes.where("category = 'fontFamily'").collect()} == {("inter", "Inter", 10), ("arial", "Arial", 5)}
    tokens = Tokens({"a": "red", "b": "#f00", "c": "blue"}, [5.0, 7.0], [], [], ["INTER"])
    s = drift.summary(codes, tokens).first()
    assert (s.unique_values, s.drifted, s.unused) == (6, 3, drift.unused(codes, tokens).count()) and s.unused == 2
    assert plan_of(drift.summary(codes, tokens)).split("== Initial Plan ==")[-1].count("InMemoryTableScan") <= 1  # one pass over the facts


def test_clusters_are_the_greedy_ones_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(extract, "ROUND", 7)
    rng = random.Random(5)
    colors = [(f"#{rng.randrange(1 << 24):06x}", rng.randrange(1, 6)) for _ in range(300)]
    heads: list[list] = []
    for value, n in sorted(colors, key=lambda c: (-c[1], c[0])):
        home = next((h for h in heads if color.delta_e(color.lab(h[0]), color.lab(value)) <= extract.NEAR), None)
        if home is None:
            heads.append([value, [value], n])
        else:
            home[1].append(value)
            home[2] += n
    heads.sort(key=lambda h: -h[2])
    found = extract.clusters(spark.createDataFrame(colors, "value string, n long"))
    assert [(r.rank, r.representative, r.members, r.total) for r in found.orderBy("rank").collect()] == [(i, *h) for i, h in enumerate(heads, 1)]
    assert "InPandas" not in plan_of(found)
    assert extract.clusters(spark.createDataFrame([], "value string, n long")).count() == 0


def test_rows_of_one_class_name_are_dealt_to_many_tasks(spark):
    rows = [("class", "jsx", f"f{i}", i, 1, v) for i, v in enumerate(["mt-[13px] flex", "text-[#3b82f7]", "mt-[13px]", "p-[8px]"] * 50)]
    found = spark.createDataFrame(rows, "fact string, kind string, file string, line int, col int, value string")
    bad = rules.tailwind_arbitrary(found, Config(Tokens({"blue": "#3b82f6"}, [8, 12], [], [], [])))
    assert "ShuffledHashJoin" in plan_of(bad) and "share" in plan_of(bad)  # a broadcast of the names made one task read what one scan gave
    got = {(r.old_value, r.suggested): r["count"] for r in bad.groupBy("old_value", "suggested").count().collect()}
    assert got == {("mt-[13px]", "mt-[12px]"): 100, ("text-[#3b82f7]", "text-[var(blue)]"): 50}


def test_copies_of_a_text_in_a_batch_are_parsed_once(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"

    def parser(text):
        with open(seen, "a") as out:
            out.write("x")
        if text == "bad":
            raise ValueError("no")
        return [{"fact": "decl", "name": n, "value": text, "line": 1, "col": 1} for n in text]

    monkeypatch.setitem(facts.PARSERS, "css", parser)
    monkeypatch.setattr(facts, "FACTS_AT_ONCE", 3)
    rows = [(f"{i}.css", t) for i, t in enumerate(["ab", "bad", "", "abcde", None] * 8)]
    found = facts.parse(spark.createDataFrame(rows, "file string, content string").coalesce(1)).collect()
    got = sorted((r.file, r.seq, r.fact, r["name"] or "", r.value, r.kind, r.origin) for r in found)
    want = [(f, k, "decl", n, t, "css", "css") for f, t in rows if t not in (None, "bad") for k, n in enumerate(t)] + [(f, 0, "error", "", "no", "css", "css") for f, t in rows if t == "bad"]
    assert got == sorted(want) and seen.read_text() == "x" * 5


def test_logged_names_of_equal_texts_are_found_once(spark):
    text = "console.log(token);\nconsole.warn(a.secret, token);\n"
    rows = [(f"src/{i}.tsx", text) for i in range(20)] + [("src/o.tsx", "console.log(password)"), ("src/p.tsx", "console.log(a + token)")]
    parsed = facts.parse(spark.createDataFrame(rows, "file string, content string")).persist()
    known = parsed.where("fact = 'tokens'")
    assert known.count() == 22 and known.select("value").distinct().count() == 3
    config = Config(Tokens({}, [], [], [], []))
    want = sorted([(f"src/{i}.tsx", line, f'"{w}" is logged') for i in range(20) for line, w in ((1, "token"), (2, "secret"))] + [("src/o.tsx", 1, '"password" is logged')])
    assert sorted((r.file, r.line, r.message) for r in rules.console_sensitive(parsed, config).collect()) == want
    unnamed = parsed.withColumn("value", F.lit(None).cast("string"))  # facts of another parser: each file is looked at
    assert sorted((r.file, r.line, r.message) for r in rules.console_sensitive(unnamed, config).collect()) == want


def test_a_batch_of_changes_is_settled_once(spark, tmp_path, monkeypatch):
    table, seen, settle = str(tmp_path / "facts"), tmp_path / "seen", watch.latest

    def counted(batches):
        for batch in batches:
            with open(seen, "a") as out:
                out.write("x" * batch.num_rows)
            yield batch

    def latest(changes):
        found = settle(changes)
        return found.mapInArrow(counted, found.schema)

    monkeypatch.setattr(watch, "latest", latest)
    rows = [(f"{i % 5}.css", "change", f".a {{ gap: {i % 3}px }}", 1, i) for i in range(20)] + [("4.css", "unlink", None, 1, 20)]
    watch.apply_batch(spark, table, spark.createDataFrame(rows, "path string, type string, content string, ts int, seq int"))
    assert seen.read_text() == "x" * 5  # every reader of the batch settled it anew
    assert {(r.file, r.value) for r in watch.read_state(spark, table).where("fact = 'decl'").collect()} == {(f"{i % 5}.css", f"{i % 3}px") for i in range(15, 19)}
    assert not list((tmp_path / "facts" / "settled").iterdir()) and not list((tmp_path / "facts" / "memo-new").iterdir())
