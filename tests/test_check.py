"""Parsers, rules, suppression, cross-file analysis and fixes on small sources."""

import pytest

from inkstone.operators import baseline, cross, diff, drift, extract, facts, fix, report, rules
from inkstone.plans.check import check
from inkstone.schema import VIOLATIONS
from inkstone.sources.config import Config, Tokens, from_dict

TOKENS = Tokens({"blue-500": "#3b82f6"}, [4, 8, 12, 16, 24], [12, 14, 16, 18, 24], [4, 8, 12], ["Inter"])
CONFIG = Config(TOKENS)

SOURCES = {
    "src/a.css": ":root { --used: #fff; --dead: 3px; --tw-x: 1 }\n.a { padding: 13px 8px; color: #ff0000; background: #ff1111 }\n/* inkstone-ignore no-arbitrary-font-size -- old */\n.b { font-size: 15px }\n.c { font-size: 15px; border-radius: 7px / 3rem; font-family: 'Arial', x }\n.d { color: var(--used); margin: calc(100% - 13px) auto }\n",
    "src/b.scss": "$blue: #3b82f6; // TODO name it\n.x { &:hover { color: $blue; gap: 0px; } }\n",
    "src/c.less": "@main: #123456;\n.y { color: @main }\n",
    "src/d.vue": "<template>\n  <p style=\"padding: 5px\" :style=\"{ marginTop: '7px', color: c }\" class=\"mt-[13px] flex\" :class=\"{ 'p-[5px]': on }\">x</p>\n</template>\n<style lang=\"scss\">\n.z { gap: 13px; }\n</style>\n",
    "src/e.component.ts": "@Component({\n  selector: 'x',\n  styles: [`\n    .q { padding: 13px }\n  `],\n  template: `<b [style.width.px]=\"3\" [ngStyle]=\"{ 'padding': '5px' }\" [ngClass]=\"['mt-[3px]']\"></b>`\n})\nexport class X {}\n",
    "src/f.svelte": "<script>let a = 1;</script>\n<p style:padding=\"5px\" class:mt-[3px]={a} class=\"m-[5px]\">x</p>\n<style>.r { padding: 13px }</style>\n",
    "src/g.blade.php": "@if(count($x) > 1)\n<p style=\"padding: 5px; color: {{ $c }}\" class='p-[5px]'>{{ '<b style=\"padding: 9px\">' }}</p>\n@endif\n",
    "src/h.tsx": "'use client';\nimport x from 'y';\nexport function Box({ a, b }) {\n  // inkstone-ignore no-console-log\n  console.log('x');\n  return <div className={cn('mt-[13px]', on && `p-[5px] ${y}`)} style={{ padding: '13px', fontSize: 15 }}>t</div>;\n}\n",
    "src/node_modules/i.css": ".a { padding: 13px }",
    "src/j.ts": "const a = 1;",
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(list(SOURCES.items()), "file string, content string")


@pytest.fixture(scope="module")
def checked(spark, sources):
    """Violations of all sources, as a table of its own."""
    return spark.createDataFrame(check(sources, CONFIG).collect(), VIOLATIONS).persist()


@pytest.fixture(scope="module")
def found(checked):
    rows = checked.collect()
    return sorted((r.file.removeprefix("src/"), r.rule_id, r.line, r.old_value, r.suggested) for r in rows)


def of(found, file, *names):
    return [(r, line, old, new) for f, r, line, old, new in found if f == file and (not names or r in names)]


def test_style_sheets(found):
    got = of(found, "a.css")
    assert ("no-hardcoded-color", 2, "#ff0000", None) in got and ("no-hardcoded-color", 2, "#ff1111", None) in got
    assert ("enforce-contrast", 2, "#ff0000", None) in got
    assert ("spacing-near-token", 2, "13px", "12px") in got and not of(found, "a.css", "no-arbitrary-spacing")[0:0]
    assert [g for g in got if g[0] == "no-arbitrary-font-size"] == [("no-arbitrary-font-size", 5, "15px", "14px")]
    assert [g for g in got if g[0] == "no-arbitrary-radius"] == [("no-arbitrary-radius", 5, "3rem", None), ("no-arbitrary-radius", 5, "7px", "8px")]
    assert ("no-unauthorized-font-family", 5, "Arial", None) in got
    assert [g[1] for g in got if g[0] == "no-dead-token"] == [1]
    assert not [g for g in got if g[1] == 6 and g[0] == "no-hardcoded-color"]


def test_variables_of_dialects(found):
    assert of(found, "b.scss", "no-hardcoded-color") == [("no-hardcoded-color", 1, "#3b82f6", "var(blue-500)")]
    assert of(found, "b.scss", "no-todo-without-ticket") == [("no-todo-without-ticket", 1, None, None)]
    assert of(found, "b.scss", "spacing-near-token") == [("spacing-near-token", 2, "0px", "4px")]
    assert of(found, "c.less", "no-hardcoded-color") == [("no-hardcoded-color", 1, "#123456", None)]


def test_templates(found):
    assert of(found, "d.vue", "no-arbitrary-spacing") == [("no-arbitrary-spacing", 2, "5px", None), ("no-arbitrary-spacing", 2, "7px", None)]
    assert of(found, "d.vue", "no-tailwind-arbitrary") == [("no-tailwind-arbitrary", 2, "mt-[13px]", "mt-[12px]"), ("no-tailwind-arbitrary", 2, "p-[5px]", "p-[4px]")]
    assert of(found, "d.vue", "spacing-near-token") == [("spacing-near-token", 5, "13px", "12px")]
    assert {g[1:3] for g in of(found, "e.component.ts")} == {(4, "13px"), (6, "5px"), (6, "mt-[3px]")}
    assert {g[1:3] for g in of(found, "f.svelte")} == {(2, "5px"), (2, "mt-[3px]"), (2, "m-[5px]"), (3, "13px")}
    assert {g[1:3] for g in of(found, "g.blade.php")} == {(2, "5px"), (2, "p-[5px]")}


LOGGED = {
    "console.log(token)": "token",
    "console.log('token', \"a\", 1)": None,
    "console.error(\n  'x',\n  user.password,\n  authToken)": "password",
    "console.log(session.id)": None,
    "console.log(a), foo(password)": None,
    "console.log(foo(password))": None,
    "console.log(load().secret, 1)": "secret",
    "console.log(`x ${token} y`)": "token",
    "console.log(`x ${a + token} y ${`in ${b.apiKey}`}`)": "apiKey",
    "console.log({ a, password })": "password",
    "console.log({ 'api_key': 1, token })": "api_key",
    "console.log({ a: password })": None,
    "console.log({ a: { password: 1 } })": None,
    "console.log({ [session]: 1 })": "session",
    "console.log({ get token() { return 1 } })": "token",
    "console.log((password))": "password",
    "console.log((a, b) => password)": None,
    "console.log(a[token])": "token",
    "console.log([token])": None,
    "console.log(a + token)": None,
    "console.log(...tokens)": None,
    "console.log(a ? token : 1)": None,
    "console.log(`token`, tag`${token}`)": None,
    "window.console.log(token)": None,
    "console.table(token)": None,
    "console.log(a.token.length)": None,
    "console.log(a.token())": None,
    "console.log(() => { console.warn(secretKey) })": "secretKey",
    "/* console.log(token) */ console.info('it', // token\n  1)": None,
    "foo(console.debug(credentials, password))": "credentials",
    "console.log(`}`, a['x'].auth)": "auth",
    "console.log(token": None,
}


def test_console_calls_name_what_the_arguments_name(spark):
    sources = spark.createDataFrame([(f"{i}.tsx", text + ";\nconst y = `${1}`;") for i, text in enumerate(LOGGED)], "file string, content string")
    got = {r.file: r for r in rules.console_sensitive(facts.parse(sources), CONFIG).collect()}
    for i, (text, want) in enumerate(LOGGED.items()):
        said = got.get(f"{i}.tsx")
        assert (said.message.split('"')[1] if said else None) == want, text
    assert (got["2.tsx"].line, got["2.tsx"].col) == (1, 0) and (got["27.tsx"].line, got["27.tsx"].col) == (1, 20)


def test_broken_style_sheets_give_one_error_and_nothing_else(spark):
    broken = {"a.css": ".a{color:red", "b.css": "}}} .b{color:red}", "c.scss": ".c{gap:1px} /* open", "d.less": ".d{content:'x}", "e.vue": "<template><p style='gap:1px'/></template><style>.e{</style>", "f.css": ".f{gap:1px} /*/"}
    fine = {"g.css": ".g{content:'}';background:url(a{b)} /* } */", "h.scss": "// it's {\n.h{#{$p}-x:1px}", "i.css": ""}
    found = facts.parse(spark.createDataFrame([*broken.items(), *fine.items()], "file string, content string")).collect()
    assert {f: [r.value for r in found if r.file == f] for f in broken} == {"a.css": ["Unclosed block"], "b.css": ["Unexpected }"], "c.scss": ["Unclosed comment"], "d.less": ["Unclosed string"], "e.vue": ["Unclosed block"], "f.css": ["Unclosed comment"]}
    assert {r.fact for r in found if r.file in broken} == {"error"} and not [r for r in found if r.file in fine and r.fact == "error"]


def test_components(found):
    got = of(found, "h.tsx")
    assert ("no-inline-styles", 6, None, None) in got and not of(found, "h.tsx", "no-console-log")
    assert {g[2] for g in got if g[0] == "no-tailwind-arbitrary"} == {"mt-[13px]", "p-[5px]"}
    assert {g[2] for g in got if g[0] == "no-arbitrary-spacing"} == {"13px"}
    assert ("no-arbitrary-font-size", 6, "15", None) in got
    assert not of(found, "node_modules/i.css") and not of(found, "j.ts")


def test_severity_and_off(spark, sources):
    quiet = Config(TOKENS, {r: "off" for r in rules.DEFAULTS} | {"no-arbitrary-font-size": "warn"})
    rows = check(sources, quiet).collect()
    assert {(r.rule_id, r.severity) for r in rows} == {("no-arbitrary-font-size", "warning")}
    own = {"x": lambda f, c: rules.violation(rules.facts_of(f, "decl").where("name = 'gap'"), "x", rules.F.lit("gap"))}
    assert {r.rule_id for r in rules.apply(facts.parse(sources), CONFIG, own).collect()} == {"x"}


def test_component_rules(spark):
    from inkstone.catalog import EXPECTED, SNIPPETS

    files = spark.createDataFrame([(f"s{k}.tsx", s) for k, s in SNIPPETS.items()], "file string, content string")
    rows = rules.apply(facts.parse(files), CONFIG).collect()
    for k, want in EXPECTED.items():
        assert sorted(r.rule_id for r in rows if r.file == f"s{k}.tsx") == sorted(want), k


def test_broken_file_is_one_warning(spark, sources):
    facts.register_parser("css", lambda t: (_ for _ in ()).throw(ValueError("bad")))
    try:
        got = rules.apply(facts.parse(sources.where("file = 'src/a.css'")), CONFIG).collect()
    finally:
        facts.register_parser("css", lambda t: facts.scan.style_facts(t, "css"))
    assert [(r.rule_id, r.line) for r in got] == [("parse-error", 1)]


def test_variant_sprawl(spark):
    button = "export function {n}({{ label, onPress, tone }}) {{\n  return <button className=\"b\" onClick={{onPress}}><span>{{label}}</span></button>;\n}}\n"
    filler = "export function F{n}({{ p{n} }}) {{ return <t{n} a{n}=\"1\"></t{n}>; }}\n"
    names = [("SaveButton", button), ("SaveButtonOld", button)] + [(str(k), filler) for k in range(3)]
    files = spark.createDataFrame([(f"f{i}.tsx", t.format(n=n)) for i, (n, t) in enumerate(names)], "file string, content string")
    rows = cross.variant_sprawl(facts.parse(files)).collect()
    assert [(r.file, r.rule_id) for r in rows] == [("f1.tsx", "variant-sprawl")] and "100 %" in rows[0].message
    assert cross.variant_sprawl(facts.parse(files.limit(4))).count() == 0
    many = spark.createDataFrame([(f"g{i:02d}.tsx", button.format(n="Save" + s)) for i, s in enumerate(["Main", "New", "Old", "Alt", "Base", "Custom", "Primary", "Secondary", "Wrapper", "Container", "V2"])], "file string, content string")
    assert [r.rule_id for r in cross.variant_sprawl(facts.parse(many)).collect()] == ["variant-sprawl"]
    assert cross.variant_sprawl(facts.parse(many), 100).count() == 55


def test_similar_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(f"k{i:03d}", rng.choice(["Card", "CardOld", "Cart", "Box"]), rng.sample("abcdef", rng.randint(0, 4)), rng.sample("uvwxyz", rng.randint(0, 4))) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, name string, props array<string>, structure array<string>")
    got = {(r.key_a, r.key_b) for r in cross.similar_pairs(df).collect()}
    a, b = df.toDF("key_a", "name_a", "props_a", "structure_a"), df.toDF("key_b", "name_b", "props_b", "structure_b")
    v, F = cross.values, cross.F
    name = v.name_similarity(F.col("name_a"), F.col("name_b"))
    total = v.variant_score(name, v.jaccard(F.col("props_a"), F.col("props_b")), v.jaccard(F.col("structure_a"), F.col("structure_b")))
    want = {(r.key_a, r.key_b) for r in a.join(b, F.col("key_a") < F.col("key_b")).where((total >= 0.75) & (name >= 0.5)).collect()}
    assert got == want and len(want) > 50


def test_fixes():
    text = ".a { padding: 18px 18px; margin: 18px }\r\n.b { x: 1 }"
    out, reasons = fix.fix_lines(text, [(1, 6, "18px", "16px"), (1, 6, "18px", "20px"), (1, 25, "18px", "4px"), (2, 1, "9px", "8px"), (9, 1, "a", "b"), (1, 1, "18px", None)])
    assert out == ".a { padding: 16px 20px; margin: 4px }\r\n.b { x: 1 }"
    assert reasons == [None, None, None, "value-mismatch", "value-mismatch", "no-fix"]


def test_fix_is_idempotent_and_baseline_is_stable(spark, sources, checked):
    v = checked
    fixes = fix.apply(v, sources)
    text = {r.file: r.content for r in fix.rewritten(fixes).collect()}
    assert "padding: 12px 8px" in text["src/a.css"] and "mt-[12px]" in text["src/d.vue"]
    assert {r.reason for r in fix.summary(fixes).collect()} >= {None, "no-fix"}
    stored = baseline.entries(v)
    assert baseline.apply(v, stored).count() == 0
    below = v.withColumn("line", rules.F.col("line") + 1)
    assert baseline.apply(below, stored).count() == 0
    c = baseline.counts(v, stored).first()
    assert c.new == 0 and c.resolved == 0 and c.total == c.baselined == c.baseline_total
    assert baseline.prune(stored, v).count() == stored.count()
    assert diff.summary(v, v).first().verdict == "pass" and fix.errors_left(v, fixes).count() < v.where("severity = 'error'").count()


def test_verdicts(spark):
    def rows(*severities):
        return spark.createDataFrame([("r", s, f"m{i}", "f", 1, 1, None, None) for i, s in enumerate(severities)], VIOLATIONS)

    none = spark.createDataFrame([], VIOLATIONS)
    for head, want in ((rows("error"), "blocking"), (rows("warning"), "pass"), (rows(*["warning"] * 6), "needs-attention")):
        assert diff.summary(none, head).first().verdict == want
    assert "blocking" in report.diff_markdown(none, rows("error")) and report.terminal(none) == "No violations"


def test_extraction_and_drift(spark):
    css = ".a { color: #3b82f6; background: #3b82f6 } .b { color: #3b82f6 } .c { color: #3c82f7; fill: #3b83f6 } .d { color: #ef4444; stroke: #ef4444 }\n.e { padding: 16px 16px; margin: 8px; font-size: 14px; border-radius: 4px; font-family: 'Inter', serif }\n"
    parsed = facts.parse(spark.createDataFrame([("a.css", css)], "file string, content string")).persist()
    used = {(r.category, r.value): r.n for r in extract.usage(parsed).collect()}
    assert used[("color", "#3b82f6")] == 3 and used[("spacing", "16")] == 2 and used[("fontFamily", "Inter")] == 1
    found = [(r.representative, len(r.members), r.total) for r in extract.clusters(extract.usage(parsed).where("category = 'color'").select("value", "n")).orderBy("rank").collect()]
    assert found == [("#3b82f6", 3, 5), ("#ef4444", 1, 2)]
    tokens = Tokens({"blue": "#3b82f6", "red": "#ff0000"}, [16, 10], [14], [4], ["Inter"])
    codes = drift.code_values(parsed)
    off = {(r.category, r.value): r.nearest for r in drift.drifted(codes, tokens).collect()}
    assert off == {("color", "#3c82f7"): "blue", ("color", "#3b83f6"): "blue", ("color", "#ef4444"): off[("color", "#ef4444")], ("spacing", "8"): "10px"}
    s = drift.summary(codes, tokens).first()
    assert (s.unique_values, s.drifted, s.unused) == (9, 4, 2) and s.gate
    empty = drift.summary(codes.limit(0), tokens).first()
    assert empty.drift_percent == 0 and not empty.gate


def test_sarif_and_counts(checked):
    import json

    v = checked
    doc = json.loads(report.sarif(v).first().document)
    results = doc["runs"][0]["results"]
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 25 and len(results) == v.count()
    assert all(r["locations"][0]["physicalLocation"]["region"]["startColumn"] >= 1 for r in results)
    s = report.check_summary(v).first()
    assert s.total == s.errors + s.warnings and not s.ok


def test_config_faults():
    good = {"tokens": {"colors": {}, "spacing": [1], "fontSizes": [], "radii": [], "fontFamilies": []}, "rules": {}}
    assert from_dict(good).wcag_level == "AA"
    for bad in ({}, {**good, "rules": {"x": "loud"}}, {**good, "baseline": {"path": "../x"}}, {**good, "wcag": {"level": "B"}}, {"tokens": {**good["tokens"], "spacing": ["a"]}, "rules": {}}):
        with pytest.raises(ValueError):
            from_dict(bad)
