import re
import time
from collections import defaultdict

from inkstone.llm import quotes as op

SCHEMA = "conv_id long, turn long, role string, text string, root int, own string"

ROWS = [
    (1, 0, "user", "First question here.\nWith a second line.\n\nAnd a paragraph of its own."),
    (1, 1, "assistant", "An answer."),
    (1, 2, "user", "On Monday someone wrote:\n> first   QUESTION here.\n> with a second line.\nMy reply to that."),
    (1, 3, "assistant", "> And a paragraph of its own.\n>> nothing known\nReply again"),
    (1, 4, "user", "> > First question here.\n> My reply to that.\n\ndeep"),
    (1, 5, "user", ">My reply to that.\n> An answer.\ntwo in one run"),
    (1, 6, "user", "> deep\n\n> An answer.\ntwo passages"),
    (1, 7, "user", "> two passages\nchain"),
    (1, 7, "user", "> two passages\nchain"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, "user", ">"),
    (2, 3, "user", "> later words"),
    (2, 4, "user", "later words"),
    (None, None, "user", "no turn"),
    (None, 1, "user", "> no turn\n> \n>>> x"),
    (4, 0, "a", "l one is here\nl two is here too\nl three\n\nnext paragraph of words\nlast line"),
    (4, 1, "b", "> l one is here\n> l two is here too\nfirst part"),
    (4, 2, "b", "> two is here too l three next\n> paragraph of\nmiddle, over the paragraph"),
    (4, 3, "b", "> one is\n>> is\na part of two words, and one"),
    (4, 4, "b", "> one is here l two was\nnearly"),
    (4, 5, "b", "answer one\nin two lines\n> l three\nanswer two\n> last line\nanswer three"),
    (4, 6, "b", "> answer one\n> in two lines\n>> l one is here l two\nyes"),
    (5, 0, "a", "so we say yes to that"),
    (5, 1, "b", "yes"),
    (5, 2, "a", "> yes\nthe line counts before the word in a line"),
    (5, 3, "a", "> we say\n> yes to\nover two lines\n> that so\n"),
    (5, 4, "b", "x x x x x x x y"),
    (5, 5, "a", "> x x x x x\n>> x x x y\n> y x\n"),
    (3, 5, "a", "tie one"),
    (3, 5, "b", "tie two\n> tie one"),
    (3, 6, "b", "> tie two\r\nok\r\n> tie one"),
]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")


def brute(rows):
    parsed = []
    for conv, turn, role, text in rows:
        lines = []
        for line in re.split("\r?\n", text or ""):
            m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            lines.append((m.group().count(">") if m else 0, line[m.end() :] if m else line))
        runs, own, broken = [], [], []
        for i, (level, body) in enumerate(lines):
            after = lines[i + 1][0] if i + 1 < len(lines) else 0
            if level:
                if i and lines[i - 1][0] == level:
                    runs[-1][1].append(body)
                else:
                    runs.append((level, [body]))
            elif not (after and re.search(op.ATTRIBUTION, body)):
                own.append(body)
                broken.append(body)
                continue
            broken.append("")
        own = "\n".join(own).strip(" \t\n\x0b\x0c\r")
        broken = "\n".join(broken)
        units = {norm(u) for u in [own, *re.split(r"\n[\x20\x09-\x0D]*\n", broken), *broken.split("\n")]} - {""}
        parsed.append((conv, turn, role, own, [(lv, norm("\n".join(b))) for lv, b in runs if norm("\n".join(b))], units))
    first = {}
    for conv, turn, _, _, _, units in parsed:
        for u in units if turn is not None else ():
            first[conv, u] = min(turn, first.get((conv, u), turn))
    part = {}
    for conv, u in {(conv, u) for conv, _, _, _, passages, _ in parsed for _, u in passages}:
        for other, turn, _, own, _, _ in parsed:
            if other == conv and turn is not None and f" {u} " in f" {norm(own)} ":
                part[conv, u] = min(turn, part.get((conv, u), turn))

    def original(conv, turn, u):
        return next((d[conv, u] for d in (first, part) if turn is not None and d.get((conv, u), turn) < turn), None)

    reply = {}
    for conv, turn, _, _, passages, _ in parsed:
        for level, u in passages:
            o = original(conv, turn, u)
            if o is not None:
                reply[conv, turn] = min(reply.get((conv, turn), (level, -o)), (level, -o))
    parent = {k: -v[1] for k, v in reply.items()}
    out = []
    for conv, turn, role, own, passages, _ in parsed:
        linked = sum(original(conv, turn, u) is not None for _, u in passages)
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out.append((conv, turn, role, own, len(passages), linked, parent.get((conv, turn)), root, depth))
    return out


def test_links_threads_and_texts_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA)
    got = op.conversations(df).collect()
    strip = [(r.conv_id, r.turn, r.role, r.own_text, r.n_passages, r.n_linked, r.parent_turn, r.thread_turn, r.depth) for r in got]
    assert sorted(map(repr, strip)) == sorted(map(repr, brute(ROWS)))
    assert {r.turn: r.n_linked for r in got if r.conv_id == 4} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 0, 5: 2, 6: 2}
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for conv in by.values():
        conv.sort(key=lambda r: r.position)
        assert [r.position for r in conv] == list(range(len(conv)))
        seen = set()
        for r in conv:
            assert r.parent_turn is None or r.parent_turn in seen
            seen.add(r.turn)
        order = [(-1 if r.thread_turn is None else r.thread_turn, -1 if r.turn is None else r.turn) for r in conv]
        assert order == sorted(order)


def test_long_texts_of_one_word_are_looked_through_once(spark):
    rows = [(1, 0, "a", "w " * 60000 + "end"), (1, 1, "b", "> " + "w " * 30000 + "end\nhm"), (1, 2, "b", "> " + "w " * 777 + "\n>> " + "w " * 70000)]
    started = time.time()
    got = op.conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert {(r.turn, r.n_linked) for r in got} == {(0, 0), (1, 1), (2, 1)} and time.time() - started < 120


def test_long_chain_and_empty(spark):
    rows = [(1, t, "user", (f"> message {t - 1}\n" if t else "") + f"message {t}") for t in range(70)]
    got = op.conversations(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert {(r.turn, r.thread_turn, r.depth) for r in got} == {(t, 0, t) for t in range(70)}
    assert op.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
