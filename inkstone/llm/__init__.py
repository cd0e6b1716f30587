"""Operators that prepare training text: extraction, linking, rules, encoding, mixing, deduplication, scoring."""
