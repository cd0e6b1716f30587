"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

SOURCES = "file string, content string"
FACTS = (
    "file string, kind string, fact string, origin string, unit int, id int, parent int, seq int, name string, value string, selector string, "
    "line int, col int, end_line int, props array<string>, structure array<string>"
)
VIOLATIONS = "rule_id string, severity string, message string, file string, line int, col int, suggested string, old_value string"
COLUMNS = [c.split()[0] for c in VIOLATIONS.split(", ")]
