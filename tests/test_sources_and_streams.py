import json
import time

import duckdb
import pytest

from inkstone import catalog
from inkstone.operators import cross, facts
from inkstone.sources import config, tokens
from inkstone.sources.files import scan
from inkstone.streaming import memo, watch

SF = "/root/testdata/sf0.001"


def test_theme_and_token_tree():
    theme = {"theme": {"colors": {"primary": "#02c39a", "current": "currentColor", "blue": {"500": "#3b82f6", "DEFAULT": "#00f"}}, "spacing": {"a": "1rem"}, "extend": {"spacing": {"b": "32px"}, "fontSize": {"s": ["14px", {}]}}, "borderRadius": {"x": 4}, "fontFamily": {"sans": ["Inter", "x"]}}}
    assert tokens.from_theme(theme) == config.Tokens({"primary": "#02c39a", "blue-500": "#3b82f6", "blue": "#00f"}, [16.0, 32.0], [14.0], [4.0], ["Inter"])
    tree = {"color": {"$type": "color", "base": {"$value": "#123456"}, "alias": {"$value": "{color.base}"}, "loop": {"$value": "{color.loop}"}, "gone": {"$value": "{x.y}"}}, "space": {"$type": "dimension", "s": {"$value": "4px"}, "font-m": {"$value": "1rem"}}, "radius": {"big": {"type": "borderRadius", "value": 9999}}, "font": {"$type": "fontFamily", "body": {"$value": ["Inter", "sans-serif"]}}, "none": {"$value": "3px"}}
    got = tokens.from_token_tree(tree)
    assert got.colors == {"color-base": "#123456", "color-alias": "#123456"} and got.spacing == [4.0, 16.0] and got.radii == [9999.0] and got.font_families == ["Inter, sans-serif"]
    assert config.draft(got)["tokens"]["fontFamilies"] == ["Inter"]


def test_all_token_files_make_one_tree(tmp_path):
    for name, tree in {
        "tokens/color.json": {"color": {"$type": "color", "base": {"$value": "#123456"}}},
        "tokens/theme.json": {"theme": {"$type": "color", "main": {"$value": "{color.base}"}}},
        "src/space.tokens.json": {"space": {"$type": "dimension", "s": {"$value": "4px"}}},
        "pkg/a/radius.json": {"radius": {"big": {"type": "borderRadius", "value": 9}}},
        "style-dictionary.config.json": {"source": ["pkg/**/*.json", "[", 3]},
        "src/package.json": {"other": {"$type": "color", "x": {"$value": "#ffffff"}}},
        "tokens/list.json": [1],
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(tree))
    (tmp_path / "tokens" / "broken.json").write_text("{ // no")
    name, found = tokens.resolve(tmp_path, None)
    assert name == "tokens" and found == config.Tokens({"color-base": "#123456", "theme-main": "#123456"}, [4.0], [], [9.0], [])


def test_detect_resolve_and_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "variables.css").write_text(":root { --accent: #ff6600; --space-s: 8px; --radius-m: 4px; --font-size-s: 14px; --other: x }\n")
    (tmp_path / "src" / "b.css").write_text(".a { padding: 16px; margin: 16px }")
    (tmp_path / "src" / "c.txt").write_text("no parser")
    files = scan(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in files.select("file").collect()) == ["b.css", "variables.css"]
    parsed = facts.parse(files)
    name, found = tokens.resolve(tmp_path, parsed)
    assert name == "css-vars" and found == config.Tokens({"accent": "#ff6600"}, [8.0], [14.0], [4.0], [])
    assert tokens.resolve(tmp_path, parsed, "code")[1].spacing == [16.0]
    with pytest.raises(ValueError):
        tokens.resolve(tmp_path, parsed, "tailwind")
    (tmp_path / "inkstone.config.json").write_text(json.dumps(config.draft(found)))
    loaded, root = config.load(tmp_path / "src")
    assert loaded.tokens.spacing == [8.0] and root == tmp_path
    config.set_baseline_enabled(tmp_path / "inkstone.config.json", True)
    assert config.load(tmp_path)[0].baseline_enabled


def test_stream_keeps_the_fact_table(spark, tmp_path):
    table, changes = str(tmp_path / "facts"), tmp_path / "changes"
    changes.mkdir()
    seen = []

    def put(n, rows):
        text = "\n".join(json.dumps({"path": p, "type": t, "content": c, "ts": f"2024-01-01T00:00:{n:02d}", "seq": i}) for i, (p, t, c) in enumerate(rows))
        (tmp_path / "part").write_text(text)
        (tmp_path / "part").rename(changes / f"{n}.json")

    put(1, [("a.css", "change", ":root { --x: 1px }"), ("b.css", "change", ".b { width: var(--x) }"), ("c.css", "change", ".c{}"), ("c.css", "unlink", None)])
    stream = spark.readStream.schema(watch.CHANGES).json(str(changes))
    query = watch.watch(stream, table, str(tmp_path / "checkpoint"), lambda s: seen.append(sorted(r.message for r in cross.dead_tokens(s).collect())), "0 seconds")
    try:
        for n, rows, want in ((2, [("b.css", "unlink", None)], ["--x is never used"]), (3, [("d.css", "change", ".d { height: var(--x) }")], [])):
            query.processAllAvailable()
            put(n, rows)
            time.sleep(0.1)
            query.processAllAvailable()
            assert seen[-1] == want
    finally:
        query.stop()
    assert {r.file for r in watch.read_state(spark, table).select("file").collect()} == {"a.css", "d.css"}


def test_a_batch_that_fails_half_way_leaves_the_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "facts")

    def put(*rows):
        watch.apply_batch(spark, table, spark.createDataFrame([(p, t, c, 1, i) for i, (p, t, c) in enumerate(rows)], "path string, type string, content string, ts int, seq int"))

    put(("a.css", "change", ".a { gap: 1px }"), ("b.css", "change", ".b { gap: 2px }"))
    before = sorted(map(str, watch.read_state(spark, table).collect()))
    monkeypatch.setattr(watch, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        put(("a.css", "change", ".a { gap: 3px }"), ("b.css", "unlink", None))
    assert sorted(map(str, watch.read_state(spark, table).collect())) == before
    monkeypatch.undo()
    for _ in range(3):
        put(("a.css", "change", ".a { gap: 3px }"), ("b.css", "unlink", None))
        assert {(r.file, r.value) for r in watch.read_state(spark, table).where("fact = 'decl'").collect()} == {("a.css", "3px")}


def test_texts_are_parsed_once_and_counts_follow_the_facts(spark, tmp_path):
    table = str(tmp_path / "facts")
    a, b, c = ":root { --x: 1px; --y: 2px } .a { gap: var(--x) }", ".b { gap: var(--y) }", ".c { gap: var(--z) } :root { --z: 1px }"
    batches = [
        ([("a.css", a), ("b.css", b), ("copy.css", a)], 2),
        ([("b.css", None), ("c.css", c), ("renamed.css", b), ("x.scss", b)], 2),  # the same text of another kind is another text
        ([("renamed.css", None), ("x.scss", None), ("empty.css", "")], 1),
        ([("b.css", b), ("a.css", None), ("copy.css", None), ("c.css", c)], 0),
    ]
    files = {}
    for n, (rows, parsed) in enumerate(batches, 1):
        files = {k: v for k, v in (files | dict(rows)).items() if v is not None}
        changes = spark.createDataFrame([(f, "change" if t is not None else "unlink", t, 1, i) for i, (f, t) in enumerate(rows)], "path string, type string, content string, ts int, seq int")
        for _ in range(2):  # a batch may be run again
            watch.apply_batch(spark, table, changes)
        state = watch.read_state(spark, table).drop("bucket")
        fresh = facts.parse(spark.createDataFrame(sorted(files.items()), "file string, content string"))
        assert sorted(map(str, state.collect())) == sorted(map(str, fresh.collect()))
        assert sorted(map(str, watch.dead_tokens(spark, table).collect())) == sorted(map(str, cross.dead_tokens(fresh).collect()))
        assert sum(r.parsed for r in memo.parsed_texts(spark, f"{table}/memo").collect()) == sum(p for _, p in batches[:n])


def test_incremental_equals_batch(spark):
    texts = {"a.css": ".a { padding: 13px }", "b.css": ".b { color: #fff }"}
    log = [("a.css", "change", ".a { gap: 1px }", 1), ("b.css", "change", texts["b.css"], 1), ("c.css", "change", ".c { gap: 2px }", 2), ("a.css", "change", texts["a.css"], 3), ("c.css", "unlink", None, 4)]
    state = spark.createDataFrame([], catalog.FACTS)
    for step in (1, 2, 3, 4):
        rows = [(p, t, c, step, i) for i, (p, t, c, s) in enumerate(log) if s == step]
        state = watch.updated(state, spark.createDataFrame(rows, "path string, type string, content string, ts int, seq int"))
    batch = facts.parse(spark.createDataFrame(list(texts.items()), "file string, content string"))
    assert sorted(map(str, state.collect())) == sorted(map(str, batch.collect()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE:
        assert df.count() > 0
        return
    found = db.execute(catalog.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(map(repr, found.fetchall()))
