"""Source files as tables: dispatch by name, ignore globs, scans and subsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffixes, tested first, then extensions, and the files that a scan leaves out.
SUFFIXES = {".component.ts": "angular", ".component.html": "angular-template", ".blade.php": "blade"}
EXTENSIONS = {"tsx": "jsx", "jsx": "jsx", "css": "css", "scss": "scss", "less": "less", "vue": "vue", "svelte": "svelte", "jinja2": "jinja2", "erb": "erb", "twig": "twig"}
IGNORED = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/*.min.css")


def kind_of(file: Column) -> Column:
    """Parser kind of a path; null if no parser takes it."""
    name = F.lower(file)
    out = F.lit(None).cast("string")
    for extension, kind in EXTENSIONS.items():
        out = F.when(F.regexp_extract(name, r"\.([^./\\]+)$", 1) == extension, kind).otherwise(out)
    for suffix, kind in SUFFIXES.items():
        out = F.when(name.endswith(suffix), kind).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def not_ignored(files: DataFrame, globs: tuple[str, ...] | list[str] = IGNORED) -> DataFrame:
    """Rows whose file matches no glob; stands before the parsers, which nothing can be pushed through."""
    for glob in globs:
        files = files.where(~F.col("file").rlike(glob_regex(glob)))
    return files


def scan(spark: SparkSession, paths: str | list[str], globs: tuple[str, ...] = IGNORED) -> DataFrame:
    """file, content of every file under the paths that has a parser."""
    read = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    named = read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("file"), F.col("value").alias("content"))
    return not_ignored(named.where(kind_of(F.col("file")).isNotNull()), globs)


def only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose file is in changed(file): a staged or changed-files scan."""
    return files.join(changed.select("file").distinct(), "file", "left_semi")
