import dataclasses
import hashlib
import random
import re

from inkstone.llm import blob_ledger as op
from tests.llm.fixtures import documents, frame, prose

KEY = "AKIA" + "Q7" * 8
SECRETS = [
    f"password = '{'x1' * 8}' and PASSWD:short then token:   {'Ab3+/=' * 4}",
    f"{KEY} AKIAshort AKIA {KEY}{KEY} xAKIA{'Z' * 20}",
    "deadbeefdeadbeef 0123456789abcdef0 0123456789abcde ABCDEF0123456789 café0123456789abcdef",
    f"secret: token {'q' * 20} ſecret={'r' * 20} Key api_key=\"{'s' * 12}\" APIKEY:{'t' * 11}",
    f"-----BEGIN RSA PRIVATE KEY-----\nghp_{'a1' * 18} xoxb-{'1' * 12} eyJ{'a' * 9}.{'b' * 9}.{'c' * 9} ftp://me:pw@host http://host:80/@",
    "",
]


def brute(text):
    found = []
    for place, rule in enumerate(op.RULES):
        pattern = rule.pattern.replace("{16,}", "+") if rule.kind == "hex" else rule.pattern
        least = 16 if rule.kind == "hex" else rule.least
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            if len(m.group(rule.group)) >= least:
                found.append((m.start(), place, rule.kind, m.end()))
    return sorted(found)


def brute_row(doc_id, text):
    spans = brute(text or "")
    base = [s for s in spans if s[1] < 3]
    text_of = lambda items: ",".join(f"{k}:{s}:{e}" for s, _, k, e in items)
    return (doc_id, *(sum(s[2] == k for s in base) for k in ("assign", "access", "hex")), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(spans), len(spans) - len(base))


def versions(spark, rows):
    return spark.createDataFrame(rows, "path long, text string, blob int")


def test_findings_equal_brute_force(spark):
    docs = documents() + [(5000 + k, t, "en", "s", 0, 7, "x") for k, t in enumerate(SECRETS * 3)]
    ledger = op.new_ledger(spark)
    held, _ = op.import_versions(frame(spark, docs).selectExpr("doc_id AS path", "text", "word"), ledger)
    got = [tuple(r) for r in op.digest(op.findings(held, ledger)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute_row(d[0], d[1])) for d in docs)
    kinds = {s.split(":")[0] for r in got for s in r[5].split(",") if s}
    assert kinds == {r.kind for r in op.RULES}
    empty = op.new_ledger(spark)
    held, _ = op.import_versions(versions(spark, []), empty)
    assert op.digest(op.findings(held, empty)).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    rng = random.Random(2)
    texts = [prose(rng, "en", 20) + " " + s for s in SECRETS[:4]]
    ledger = op.new_ledger(spark)

    def scan(rows, rules=op.RULES):
        held, wanted = op.import_versions(versions(spark, [(p, t, 0) for p, t in rows]), ledger, rules)
        pairs = {(bytes(r.blob).hex(), name) for r in wanted.collect() for name in r.rules}
        return op.findings(held, ledger, rules).collect(), pairs

    blob = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    every = {r.name for r in op.RULES}
    _, pairs = scan([(1, texts[0]), (2, texts[0]), (3, texts[1]), (4, None)])
    assert pairs == {(blob(t), n) for t in (texts[0], texts[1], None) for n in every}
    rows, pairs = scan([(9, texts[0]), (1, texts[1]), (5, texts[2]), (6, "")])  # renamed, set back, new, empty like null
    assert pairs == {(blob(texts[2]), n) for n in every}
    assert {r.path: [(s.kind, s.start, s.end) for s in r.spans] for r in rows}[9] == [(k, s, e) for s, _, k, e in brute(texts[0])]
    newer = tuple(dataclasses.replace(r, version=2, pattern="[0-9a-f]{20,}") if r.kind == "hex" else r for r in op.RULES)
    rows, pairs = scan([(1, texts[2]), (7, texts[3])], newer)
    assert pairs == {(blob(texts[2]), "hex@2")} | {(blob(texts[3]), r.name) for r in newer}
    assert not [s for r in rows for s in r.spans if s.kind == "hex" and s.end - s.start < 20]
    _, pairs = scan([(1, texts[2]), (7, texts[3])], newer)
    assert not pairs
    op.read_ledger(spark, ledger).limit(2).write.mode("append").parquet(ledger)  # as an import that was run twice leaves it
    rows, _ = scan([(1, texts[2])], newer)
    assert len(rows) == 1 and len(set(rows[0].spans)) == len(rows[0].spans)
