import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import pii as op
from tests.llm.fixtures import documents, frame


def luhn_brute(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn_brute(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, ok) in RULES.items() for m in re.finditer(pattern, text or "") if ok(m.group())]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()%é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert op.base_spans(text) == brute(text)


def brute_added(text, base):
    """Kind by kind: matches that pass their check, cover no span found so far and whose context lifts them to the limit."""
    found = [(s, e) for _, s, e in base]
    out = []
    for kind, pattern, ok in op.PROPOSED:
        mine = []
        for m in re.finditer(pattern, text):
            near = (text[max(0, m.start() - 48) : m.start()] + " " + text[m.end() : m.end() + 48]).lower()
            points = round(10 * op.OWN_SCORE[kind]) + 3 * any(re.search("(?<![a-z])" + re.escape(w), near) for w in op.CONTEXT[kind]) - 3 * any(w in near for w in op.CONTRARY.get(kind, ()))
            if ok(m.group()) and points >= 5 and all(m.end() <= s or e <= m.start() for s, e in found):
                mine.append((kind, m.start(), m.end()))
        out += mine
        found += [m[1:] for m in mine]
    return out


def text_with_data(rng):
    bits = ["token =", "tel", "account", "serial", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "736 555 2678", "12345678", "5493001KJTIIGC8Y1R12", "lei", "+1 (736) 555-2678", "a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE88370400440532013000", "words", "é", "12"]
    return " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))


def test_query_digest_equals_brute_force(spark):
    rng = random.Random(2)
    rows = documents() + [(6000 + k, text_with_data(rng), "en", "s0", 0, 7, "x") for k in range(60)]
    got = {}
    for r in op.digest(op.find_spans(frame(spark, rows))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for row in rows:
        base = brute(row[1])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        for r in got[row[0]]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in op.BASE)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert r.spans.startswith(listed)
            added = [x for x in r.spans[len(listed) :].strip(",").split(",") if x]
            assert added == [":".join(map(str, a)) for a in brute_added(row[1] or "", base)]
            assert (r.n_added, r.n_spans) == (len(added), len(base) + len(added))
            assert [x.rsplit(":", 1)[0] for x in r.scored.split(",")] == r.spans.split(",") or not r.spans
    assert op.digest(op.find_spans(frame(spark, []))).count() == 0


def test_checksums_context_and_redaction(spark):
    assert op.mod97("GB82WEST12345698765432") and not op.mod97("GB83WEST12345698765432")
    assert [s[:3] for s in op.find("pay to GB82 WEST 1234 5698 7654 32 now")] == [("iban", 7, 34)]
    plain, near, far = (op.find(f"{w} 4111 1111 1111 1111")[0][3] for w in ("zz", "credit card", "isbn"))
    assert far < plain < near
    # The same characters are taken or left by the words around them alone.
    for kind, value, word, against in (("secret", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "token", "commit"), ("national", "736 555 2678", "phone", "isbn"), ("account", "12345678", "account", "serial"), ("lei", "5493001KJTIIGC8Y1R12", "issuer", "serial")):
        kinds = [[s[0] for s in op.find(t)] for t in (f"{word} {value}", f"zz {value}", f"{word} {against} {value}", f"{word} {'z' * 60} {value}")]
        assert kinds == [[kind], [], [], []], kind
    assert [s[0] for s in op.find("DE89370400440532013000")] == ["iban"] and op.find("serial DE89370400440532013000") == []
    assert op.find("issuer 5493001KJTIIGC8Y1R13") == []
    out = {r.doc_id: r.text for r in op.redact(frame(spark, [(1, "to é a@b.cd, +1 736 555 2678.", "en", "s", 0, 1, "x"), (2, None, "en", "s", 0, 1, "x")])).collect()}
    assert out == {1: "to é <email>, <phone>.", 2: None}


def test_long_runs_stay_linear():
    assert op.base_spans("a" * 300_000 + "@" + "." * 100_000) == []
    assert op.base_spans("1" * 300_000) == []
