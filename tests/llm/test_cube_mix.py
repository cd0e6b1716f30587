import re

import numpy as np

from inkstone.llm import cube_mix as op
from tests.llm.fixtures import documents, frame


def waterfill(sizes, weights, share=1.5, most=2.0):
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w >= most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ -= set(over)
    return targets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected_targets(rows):
    """source -> target for (source, text) rows, by plain water-filling."""
    sources = sorted({s for s, _ in rows if s is not None}) + [None] * any(s is None for s, _ in rows)
    size = [sum(len(words(t)) for s, t in rows if s == source) for source in sources]
    return dict(zip(sources, waterfill(size, [(3, 1, 2)[i % 3] for i in range(len(sources))]), strict=True))


def test_flight_keeps_both_totals_and_leaves_two():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 500, 700).astype(float), rng.random(700)
    out = op.fly(size, chance, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - chance.sum()) < 1e-5 and abs((out * size).sum() - (chance * size).sum()) < 1e-2
    landed = op.land(size, out)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (chance * size).sum()) <= 1000
    ties = op.fly(np.full(9, 4.0), np.full(9, 1 / 3), np.random.default_rng(1))
    assert abs(ties.sum() - 3) < 1e-6


def test_chances_are_kept_on_average():
    size, chance = np.array([5.0, 9, 1, 40, 7]), np.array([0.2, 0.5, 0.9, 0.4, 0.3])
    mean = np.mean([op.fly(size, chance, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.03


def test_mix_meets_targets(spark):
    rows = documents(n=600)
    df = frame(spark, rows)
    runs = [sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken, str(r.source)) for r in op.mix(df.repartition(k), chunk=64).collect()) for k in (1, 5)]
    assert runs[0] == runs[1]
    got = runs[0]
    assert len(got) == len(rows)
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(len((r[1] or "").split(" ")) if (r[1] or "").strip() else 0 for r in rows if r[3] == s) for s in sources}
    want = dict(zip(map(str, sources), waterfill([size[s] for s in sources], [(3, 1, 2)[i % 3] for i in range(len(sources))]), strict=True))
    for s in map(str, sources):
        mine = [g for g in got if g[5] == s]
        assert all(abs(g[3] - want[s]) < 1e-6 for g in mine)
        assert abs(sum(g[4] for g in mine) - want[s]) <= max(g[1] for g in mine)
        assert all(g[4] in (0, g[1], 2 * g[1]) for g in mine)


def test_applied_mix_repeats_rows_and_keeps_columns(spark):
    df = frame(spark)
    out = op.apply_mix(df)
    assert out.columns == df.columns
    taken = {}
    for r in op.mix(df).collect():
        if r.doc_id != 2004:
            taken[r.doc_id] = r.taken // r.size if r.size else 0
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert {k: v for k, v in seen.items() if k != 2004} == {k: v for k, v in taken.items() if v}
    assert op.mix(frame(spark, [])).count() == 0


def test_applied_mix_takes_what_mix_takes_with_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, r[1], r[2], f"s{i % 5}", *r[4:]) for i, r in enumerate(documents(n=400)) if r[1] and r[1].strip()]
    df = frame(spark, rows + rows[:1] * 5)
    taken, wanted, longest = {}, {}, {}
    for r in op.apply_mix(df).collect():
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in op.mix(df).collect():
        wanted[r.source], longest[r.source] = r.target, max(longest.get(r.source, 0), r.size)
    mixed = {}
    for r in op.mix(df).collect():
        mixed[r.source] = mixed.get(r.source, 0) + r.taken
    assert {s: n for s, n in mixed.items() if n} == taken
    assert all(abs(taken.get(s, 0) - wanted[s]) <= longest[s] for s in wanted)


def test_applied_mix_keeps_columns_with_the_names_of_working_columns(spark):
    names = ["mix_id", "mix_source", "mix_size", "mix_copies", "mix_extra", "mix_hash", "mix_tie", "mix_place", "mix_first", "id__", "copy__", "whole", "extra", "seq", "part", "before", "n", "a.b"]
    df = frame(spark)
    wide = df.select("*", *[df["doc_id"].cast("string").alias(n) for n in names])
    out = op.apply_mix(wide)
    assert out.columns == wide.columns
    assert sorted(map(repr, out.select(*df.columns).collect())) == sorted(map(repr, op.apply_mix(df).collect()))
    assert all(r[n] == (None if r.doc_id is None else str(r.doc_id)) for r in out.collect() for n in names)
