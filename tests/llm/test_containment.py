import random
import re

from inkstone.llm import containment as op
from tests.llm.fixtures import documents, frame, prose


def ws(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def runs(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    best = {}
    for item_id, text in items:
        w = ws(text)
        if not w:
            continue
        k = min(5, len(w))
        own = runs(w, k)
        for d in docs:
            found = len(own & runs(ws(d[1]), k))
            if found >= 0.8 * len(own):
                key = (str(d[0]), str(item_id))
                best[key] = max(best.get(key, (0, 0, 0)), (round(found / len(own), 6), len(own), found))
    return sorted((*k, v[1], v[2], v[0]) for k, v in best.items())


def test_every_contained_item_is_found(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, "en", n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 15, 24, 33, 47, 60])] + [(50, None), (51, " "), (None, prose(rng, "fr", 20))]
    docs = documents()
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        for cut in (0, 1, 2, 4, len(w) // 5):  # whole, then with words changed
            changed = list(w)
            for c in range(cut):
                changed[(c * 5 + 2) % len(changed) if changed else 0 : (c * 5 + 2) % len(changed) + 1 if changed else 0] = ["zz"]
            docs.append((3000 + 10 * k + cut, prose(rng, "en", 400) + "\n" + " ".join(changed).upper() + "  " + prose(rng, "fr", 50), "en", "s0", 0, 7, "x"))
    got = sorted((str(r.doc_id), str(r.item_id), r.n_item, r.n_found, r.containment) for r in op.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute(docs, items) and len(got) > 20


def test_dropping_and_empty_tables(spark):
    items = spark.createDataFrame([(1, documents()[3][1])], "item_id long, text string")
    df = frame(spark)
    out = op.drop_contaminated(df, items)
    assert out.columns == df.columns and out.count() == df.count() - len(brute(documents(), [(1, documents()[3][1])]))
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.contained_items(df, none).count() == 0 and op.drop_contaminated(df, none).count() == df.count()
    assert op.contained_items(frame(spark, []), items).count() == 0
