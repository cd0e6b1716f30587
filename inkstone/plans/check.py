"""End to end: files to violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators import cross, facts, rules, suppress
from inkstone.schema import COLUMNS
from inkstone.sources.config import Config
from inkstone.sources.files import not_ignored


def check(sources: DataFrame, config: Config, own_rules: dict[str, rules.Rule] | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """Violations of sources(file, content). Files are filtered before parsing and parsed once; pass `parsed` to reuse a stored fact table."""
    kept = not_ignored(sources, config.ignore)
    found = facts.stored(facts.parse(kept)) if parsed is None else parsed
    per_file = rules.apply(found, config, own_rules)
    targets = suppress.directives(found, suppress.source_lines(kept))
    free = suppress.apply(suppress.suppressible(per_file, found), targets).select(*COLUMNS)
    return cross.analyse(found, free, config).withColumn("severity", F.coalesce("severity", F.lit("warning")))
