import math
import re
from collections import Counter

from inkstone.llm import divergence as op
from tests.llm.fixtures import documents, frame


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_base(text):
    text = text or ""
    w = split(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


EXTRA = [
    (4000, "a b c a b c a b c d\nx y\nx y\n \n \nx  y", "en", "s0", 0, 7, "x"),
    (4001, "aa bb aa bb aa bb", "fr", "s0", 0, 7, "x"),
    (4002, "\x0b\x0c\r tab\tand ## $$ |", "en", "s0", 0, 7, "x"),
    (4003, "q " * 5000, "en", "s0", 0, 7, "x"),
]


def test_base_measures_equal_brute_force(spark):
    rows = documents() + EXTRA
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op.base_measures(frame(spark, rows)).collect())
    want = []
    for r in rows:
        b = brute_base(r[1])
        want.append((str(r[0]), *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want)


def test_word_distance_equals_brute_force(spark):
    rows = documents()
    counts = {}
    for r in rows:
        counts.setdefault(r[2], Counter()).update(split(r[1]))
    refs = {k: {w: n / sum(c.values()) for w, n in c.items() if n * 512 >= sum(c.values())} for k, c in counts.items()}

    def half(p, q):
        return sum(x * math.log2(2 * x / (p + q)) / 2 for x in (p, q) if x > 0)

    want = []
    for r in rows:
        w, ref = split(r[1]), refs[r[2]]
        if not w:
            want.append((str(r[0]), None))
            continue
        c = Counter(w)
        js = sum(half(c[x] / len(w), q) for x, q in ref.items()) + half(max(0, 1 - sum(c[x] for x in ref) / len(w)), max(0, 1 - sum(ref.values())))
        want.append((str(r[0]), round(math.sqrt(max(0, js)), 4)))
    got = [(str(r.doc_id), None if r.word_distance is None else round(r.word_distance, 4)) for r in op.judge(frame(spark, rows)).collect()]
    key = lambda x: (x[0], x[1] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and (a[1] is None) == (b[1] is None) and abs((a[1] or 0) - (b[1] or 0)) < 2e-4


def test_odd_text_goes_and_prose_stays(spark):
    odd = " ".join(f"{k}%%% #{k * k}" for k in range(150))
    rows = documents() + [(5000, odd, "en", "s0", 0, 7, "x")]
    kept = {r.doc_id: r.kept for r in op.judge(frame(spark, rows)).collect()}
    long_enough = [r[0] for r in rows if len(split(r[1])) >= 60 and r[0] is not None and r[0] < 1000]
    assert not kept[5000] and sum(kept[i] for i in long_enough) >= 0.95 * len(long_enough)
    assert op.judge(frame(spark, [])).count() == 0
