"""Applying fixes: one row for each file, its violations beside its text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "file string, content string, rule_id string, line int, col int, old_value string, suggested string, status string, reason string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def fix_lines(text: str, wanted: list[tuple]) -> tuple[str, list[str | None]]:
    """New text and, for each (line, col, old, new), why it was skipped (None: applied). Fixes of a line are sought from left to right behind
    the ones before them and written from right to left; line ends stay."""
    end = "\r\n" if "\r\n" in text else "\n"
    lines = text.split(end)
    reasons: list[str | None] = [None] * len(wanted)
    by_line: dict[int, list[int]] = {}
    for i, (line, _, old, new) in enumerate(wanted):
        if new is None or old is None:
            reasons[i] = "no-fix"
        elif not 1 <= line <= len(lines):
            reasons[i] = "value-mismatch"
        else:
            by_line.setdefault(line, []).append(i)
    for line, items in by_line.items():
        body, cursor, found = lines[line - 1], 0, []
        for i in sorted(items, key=lambda k: wanted[k][1]):
            _, col, old, new = wanted[i]
            at = body.find(old, max(cursor, col - 1, 0))
            if at < 0:
                at = body.find(old, cursor)
            if at < 0:
                reasons[i] = "value-mismatch"
            else:
                found.append((at, old, new))
                cursor = at + len(old)
        for at, old, new in reversed(found):
            body = body[:at] + new + body[at + len(old) :]
        lines[line - 1] = body
    return end.join(lines), reasons


def apply(violations: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each violation with status applied or skipped and the reason; the first row of a file holds its new
    content. The violations of a file are gathered in one row, in an order of their own, and meet its text there; tasks see batches of such rows."""
    held = ["line", "col", "rule_id", "old_value", "suggested"]
    wanted = violations.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("wanted"))
    text = sources.select("file", "content").groupBy("file").agg(F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in NAMES}
            for file, content, rows in zip(*(batch.column(c).to_pylist() for c in ("file", "content", "wanted")), strict=True):
                if content is None:
                    fixed, reasons = None, ["file-read-error"] * len(rows)
                else:
                    fixed, reasons = fix_lines(content, [(r["line"], r["col"], r["old_value"], r["suggested"]) for r in rows])
                out["file"] += [file] * len(rows)
                out["content"] += [fixed, *[None] * (len(rows) - 1)]
                for name in held:
                    out[name] += [r[name] for r in rows]
                out["status"] += ["skipped" if r else "applied" for r in reasons]
                out["reason"] += reasons
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int32() if n in ("line", "col") else pa.string()) for n in NAMES], names=NAMES)

    return wanted.join(text, "file", "left").select("file", "content", "wanted").mapInArrow(run, RESULT)


def rewritten(fixes: DataFrame) -> DataFrame:
    """file, content of every file that a fix changed."""
    changed = F.count_if(F.col("status") == "applied") > 0
    return fixes.groupBy("file").agg(F.max("content").alias("content"), changed.alias("changed")).where("changed").drop("changed")


def summary(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def errors_left(violations: DataFrame, fixes: DataFrame) -> DataFrame:
    """Errors that no applied fix removed."""
    key = ["file", "line", "col", "rule_id", "old_value"]
    done = fixes.where("status = 'applied'").select(*[F.col(c).alias(f"d_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    return violations.where("severity = 'error'").join(done, same, "left_anti")
