"""Personal data and secrets: patterns propose spans, checksums confirm them, nearby words move their score.

Base kinds are email, ip, card and phone, found leftmost and without overlap within a kind; a match that fails its check is
dropped and the search goes on after it. Every span has a score between 0 and 1: the kind's own, raised by MOVE if one of its CONTEXT words
stands within WINDOW characters on either side and lowered by MOVE if a CONTRARY one does. No score removes a base span. The method adds spans of
further kinds where no base span and no earlier added one stands, and these stay only if their score is LEAST or more:

- iban (mod-97) and lei (mod-97 over 20 characters): the checksum of an iban is enough unless a contrary word is near; a lei needs a context word;
- account (8 to 18 digits), national (a phone number without its country) and secret (20 characters or more with letters and digits): nothing confirms
  them but a context word.

Offsets count code points and ends are exclusive. Defined cases: null and empty texts have no span; ids may repeat, each row is
searched; other columns are ignored; an empty table gives an empty result. Texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "lei", "secret", "national", "account")
BASE, ADDED = KINDS[:4], KINDS[4:]
# The patterns of the base kinds. A dotted number that matches does so from the first digit of its run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
LEI = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{18}[0-9]{2}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}={0,2}")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20/-][0-9]{3,4}(?:[\x20-][0-9]{3,4}){0,2}(?![0-9A-Za-z])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{8,18}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[0-9]")
WINDOW, LEAST, MOVE = 48, 0.5, 0.3
OWN_SCORE = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.7, "lei": 0.4, "secret": 0.3, "national": 0.3, "account": 0.2}
CONTEXT = {
    "email": ("mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "lei": ("lei", "legal entity", "issuer"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "private key", "credential", "bearer"),
    "national": ("phone", "call", "tel", "mobile", "fax"),
    "account": ("account", "acct", "konto", "cuenta", "compte", "routing", "iban"),
}
CONTRARY = {
    "ip": ("version", "release", "section"), "card": ("isbn", "order no", "serial"), "phone": ("isbn", "serial"), "iban": ("example", "serial", "part no"), "lei": ("serial", "part no"),
    "secret": ("checksum", "sha256", "commit", "digest"), "national": ("isbn", "serial", "order no", "pages"), "account": ("isbn", "serial", "order no"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    left = 0
    for c in turned:
        left = (left * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return left == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _ip_ok(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match.split("."))


def _card_ok(match: str) -> bool:
    digits = _digits(match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(match: str) -> bool:
    return 9 <= len(_digits(match)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base match that passes its check, by kind and then start."""
    found = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:  # the part before an @ is the run of its characters since the last match
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done = m.end()
                found.append(("email", start, done))
            at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for kind, pattern, ok in (("ip", IP, _ip_ok), ("card", CARD, _card_ok), ("phone", PHONE, _phone_ok)):
            if kind != "phone" or "+" in text:
                found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m.group())]
    return found


def near_words(text: str, start: int, end: int) -> str:
    return (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = near_words(text, start, end)
    up = any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in CONTEXT[kind])
    down = any(w in near for w in CONTRARY.get(kind, ()))
    return round(max(0.0, min(1.0, OWN_SCORE[kind] + MOVE * up - MOVE * down)), 6)


def _mixed(match: str) -> bool:
    return any(c.isdigit() for c in match) and any(c.isalpha() for c in match)


PROPOSED = (
    ("iban", IBAN, lambda m: mod97(m.replace(" ", ""))),
    ("lei", LEI, lambda m: mod97(m[-4:] + m[:-4])),
    ("secret", SECRET, _mixed),
    ("national", NATIONAL, lambda m: 7 <= len(_digits(m)) <= 12),
    ("account", ACCOUNT, lambda m: True),
)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans with scores, by kind in the order of KINDS and then start."""
    spans = [(k, s, e, score(text, k, s, e)) for k, s, e in base_spans(text)]
    if DIGIT.search(text):
        for kind, pattern, ok in PROPOSED:
            taken = sorted((s, e) for _, s, e, _ in spans)
            reach = list(accumulate((e for _, e in taken), max))  # the furthest end up to each start
            for m in pattern.finditer(text):
                start, end = m.span()
                before = bisect_left(taken, (end,))
                free = not before or reach[before - 1] <= start
                if free and ok(m.group()) and (value := score(text, kind, start, end)) >= LEAST:
                    spans.append((kind, start, end, value))
    return spans


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in ((x.as_py() or "") for x in batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) for every row of docs(doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return plain.mapInArrow(_spans, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, the list of all spans, how many were added and how many there are, the spans with their
    scores and the highest score, from find_spans."""

    def listed(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def scored(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["score"], 1))), ",")

    counts = [count(kind) for kind in BASE]
    added = F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_added")
    return spans.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        added, F.size("spans").cast("long").alias("n_spans"), scored(F.col("spans")).alias("scored"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the kind
    that starts first. Columns are those of docs."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = columns.index("text"), []
            for value in batch.column(at):
                text = value.as_py()
                done, pieces = 0, []
                for kind, start, end, _ in sorted(find(text or ""), key=lambda s: (s[1], s[2])):
                    if start >= done:
                        pieces += [text[done:start], f"<{kind}>"]
                    done = max(done, end)
                out.append(text if text is None else "".join(pieces) + text[done:])
            arrays = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)
