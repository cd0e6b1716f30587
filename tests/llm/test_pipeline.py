"""Each stage against a plain version of its decision, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from inkstone.llm import subword_quality
from inkstone.llm.oracle import ORACLE
from inkstone.llm.queries import QUERIES, oracle_sql
from tests.llm.test_containment import brute as contained
from tests.llm.test_cube_mix import expected_targets, words
from tests.llm.test_simhash_gph import jaccard_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_decide_like_plain_versions(spark, stages):
    def rows(df):
        return [tuple(r) for r in df.orderBy("doc_id").collect()]

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = stages[0]
    good = {r.doc_id for r in subword_quality.score_quality(before, labels).collect() if r.predicted}
    assert rows(after) == [r for r in rows(before) if r[0] in good] and len(rows(after)) < len(rows(before))
    before, after = stages[1]
    mine = rows(before)
    roots = jaccard_classes([r[1] for r in mine], within_bits=True)
    assert rows(after) == [r for i, r in enumerate(mine) if roots[i] == i]  # mine is in the order of doc_id
    before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in contained(rows(before), items)}
    assert rows(after) == [r for r in rows(before) if str(r[0]) not in bad]
    before, after = stages[3]
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    want, taken, longest = expected_targets([(r.source, r.text) for r in before.collect()]), {}, {}
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
        longest[r.source] = max(longest.get(r.source, 0), len(words(r.text)))
    assert all(abs(taken.get(s, 0) - t) <= longest.get(s, t) for s, t in want.items())
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2
    last, encoded = stages[4]
    got = encoded.orderBy("start").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in last.select("doc_id").orderBy("doc_id").collect()]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    for df, _ in stages:
        assert df.columns == stages[0][0].columns


def test_oracles_agree_on_the_small_tables(spark):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert set(oracle_sql()) <= set(QUERIES) and ORACLE
    for name, sql in oracle_sql().items():
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        want = sorted(map(repr, found.fetchall()))
        got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(columns).collect())
        assert got == want, name
        if name == "op2_quoted_replies":
            linked = QUERIES[name](spark, SF).where("n_linked > 0").count()
            assert linked > 0.5 * len(got)
