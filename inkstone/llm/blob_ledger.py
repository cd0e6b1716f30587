"""Secret scans over a ledger of contents: every version of a text is addressed by its content, a content is scanned once for
each version of each rule, and what is found is joined back to every path that ever held it.

A ledger is one table in the shared folder. A row says of one blob (the sha256 of a text) which rule versions it was scanned with, and the
spans they found; it is written in one job, so that no pair counts as scanned without its findings. An import addresses the given versions,
takes the pairs of blob and rule version that the ledger lacks, brings one copy of each such text to a task and
appends the outcome. A new version of a rule makes all its pairs unseen again; a path that is renamed, copied or set back makes none.
Copies of a text are merged in each task before any text is sent, so a text with very many paths is no hot key.

Defined cases: a null text is the empty one; rows that share a path are versions of it, each with its own row in the result; a null
path is carried; rows that are equal stay as many; an empty table gives an empty result; other columns are ignored. An import that is
repeated after a failure may scan pairs twice: equal findings count once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.common import materialize, scratch_dir


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and without overlap, whose group has at least `least` characters. Where `hints` are given, a text in
    lower case that holds none of them has no match."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in their order.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, 0, False, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}"),  # runs of these characters, of which shorter ones would be dropped
)
#: Shapes of well-known credentials.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("login", 1, r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x09-\x0D\x20/:@]+:[^\x09-\x0D\x20/:@]+@", hints=("://",)),
)
RULES = (*BASE, *ADDED)

ENTRY = "blob binary, rules array<string>, spans array<struct<rule: string, start: long, end: long>>"


def addressed(versions: DataFrame) -> DataFrame:
    """path, text and blob (the sha256 of the text) of versions(path, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.select("path", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))


def find(text: str, rules: tuple[Rule, ...], compiled: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """(rule name, start, end) of all matches, in code points."""
    found, lower = [], text.lower()
    for rule in rules:
        if not rule.hints or any(h in lower for h in rule.hints):
            found += [(rule.name, m.start(), m.end()) for m in compiled[rule.name].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return found


def scanner(rules: tuple[Rule, ...]):
    """A mapInArrow function: blob, text, rules (names) -> rows of a ledger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.name: re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for text, names in zip(batch.column("text"), batch.column("rules").to_pylist(), strict=True):
                wanted = rules if len(names) == len(rules) else tuple(r for r in rules if r.name in names)
                spans.append([dict(zip(("rule", "start", "end"), s, strict=True)) for s in find(text.as_py(), wanted, compiled)])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(spans, kind)], names=["blob", "rules", "spans"])

    return run


def new_ledger(spark: SparkSession) -> str:
    """The path of an empty ledger in the shared folder."""
    path = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], ENTRY).write.parquet(path)
    return path


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(ledger)


def unseen(held: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and the names of the rules whose versions the ledger lacks for it, of held(blob)."""
    known = read_ledger(held.sparkSession, ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("known"))
    lacking = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("known", F.array().cast("array<string>")))
    return held.select("blob").distinct().join(known, "blob", "left").select("blob", lacking.alias("rules")).where(F.size("rules") > 0)


def import_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what versions(path, text) hold that the ledger has not seen, and append it. Returns path and blob of every version, and
    the scanned pairs as (blob, rules)."""
    given = addressed(versions)
    held = materialize(given.select("path", "blob"), "ledger-paths")
    wanted = materialize(unseen(held, ledger, rules), "ledger-unseen")
    one_each = given.groupBy("blob").agg(F.first("text").alias("text"))  # equal texts by their address; merged in each task first
    texts = one_each.join(wanted.hint("merge"), "blob").select("blob", "text", "rules")
    texts.mapInArrow(scanner(rules), ENTRY).write.mode("append").parquet(ledger)
    return held, wanted


def findings(held: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and spans (kind, start, end; by start, then the order of the rules) of every row of held(path, blob), by the given
    rules' versions alone."""
    names, kinds = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    every = F.array_distinct(F.flatten(F.collect_list("spans")))
    placed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["rule"]).cast("int").alias("place"), s["end"].alias("end")))
    known = F.array_sort(F.filter(placed, lambda s: s["place"] > 0))
    spans = F.transform(known, lambda s: F.struct(F.get(kinds, s["place"] - 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_blob = read_ledger(held.sparkSession, ledger).groupBy("blob").agg(spans.alias("spans"))
    return held.join(by_blob.where(F.size("spans") > 0).hint("merge"), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<kind: string, start: long, end: long>>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans as text, and how many were added, from findings with doc_id as path."""

    def listed(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), *map(count, kinds), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
