import itertools
import re
from collections import Counter

from inkstone.llm import filter_audit as op
from tests.llm.fixtures import SCHEMA, documents, frame

LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    lows = {}
    for d in docs:
        if d[0] is not None:
            lows[d[1] or ""] = min(d[0], lows.get(d[1] or "", d[0]))
    cells = {}
    for d in docs:
        text = d[1] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (d[0] is not None and lows[text] < d[0])
        cells.setdefault(d[2] or "", Counter())[fails, d[0] in good, d[0] in toxic] += 1
    out = {}
    for part, masks in cells.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                row = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
                for (fails, is_good, is_toxic), n in masks.items():
                    gone, hit = set(order[:step]) & set(fails), f in fails
                    row["kept"] += n * (not gone and not hit)
                    row["removed"] += n * (not gone and hit)
                    row["redundant"] += n * bool(gone and hit)
                    row["unique_fails"] += n * (fails == f)
                    row["good_lost"] += n * (not gone and hit and is_good)
                    row["toxic_lost"] += n * (not gone and hit and is_toxic)
                shapley[f] += row["removed"]
                out[part, "".join(order), step + 1] = row
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = shapley[order[step - 1]]
    return out


def rows():
    docs = documents()
    long = "word " * 70000
    docs += [(3000 + k, long + tail, "en", "s", 0, 7, "x") for k, tail in enumerate(("a", "a", "b", "", "c"))]  # the last block differs
    docs += [(3100, long + "a", "fr", "s", 0, 7, "x"), (None, long + "a", None, "s", 0, 7, "x"), (3000, long + "a", "en", "s", 0, 7, "x")]
    docs += [(3200 + k, f"{'A' if k % 2 else 'a'}bc # {'word ' * (k % 3)}", "en", "s", 0, 7, "x") for k in range(9)]
    docs += [(3300, " ".join(f"W{i}" for i in range(300)), "de", "s", 0, 7, "x"), (3301, " ".join(f"w{i}" for i in range(300)), "", "s", 0, 7, "x")]
    return docs


def test_every_order_equals_brute_force(spark):
    labels = [(i, i % 2, i % 3 == 0, "x") for i in range(0, 4000, 1)] + [(3000, 0, 1, "y"), (None, 1, 1, "z"), (3001, None, None, "z")]
    labels = [(d, None if q is None else int(q), None if t is None else int(t), p) for d, q, t, p in labels]
    got = op.audit(frame(spark, rows()), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows(), [r[:3] for r in labels])
    assert len(got) == len(want) == 600 * len({p for p, _, _ in want})
    for r in got:
        assert {k: r[k] for k in want[r.part, r.filter_order, r.step]} == want[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)


def test_texts_that_share_all_hashes_are_told_apart(spark, monkeypatch):
    """With a hash that sees the length only, every decision falls to the texts."""
    monkeypatch.setattr(op, "refined", lambda key, block: key)
    labels = spark.createDataFrame([], LABELS)
    got = op.audit(frame(spark, rows()), labels).collect()
    want = brute(rows(), [])
    assert all(r.kept == want[r.part, r.filter_order, r.step]["kept"] and r.shapley == want[r.part, r.filter_order, r.step]["shapley"] for r in got) and len(got) == len(want)


def test_empty_tables(spark):
    assert op.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0
