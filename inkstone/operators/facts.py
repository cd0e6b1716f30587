"""Parsing: files to one table of facts, in one pass."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import values
from inkstone.operators import scan
from inkstone.schema import FACTS
from inkstone.session import scratch_folder
from inkstone.sources.files import kind_of

#: Raised whenever a parser gives other facts for the same text: what is remembered of older ones is not used.
PARSER_VERSION = 2
FACTS_AT_ONCE = 20_000
FIELDS = [tuple(c.split()) for c in FACTS.split(", ")]
NAMES = [name for name, _ in FIELDS]
TYPES, DEFAULTS = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}, {"origin": "css", "unit": 0}
STRINGS = re.compile(r"\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'|`((?:\\.|[^`\\])*)`", re.S)
PAIR = re.compile(r"(?:^|[{,])\s*['\"]?([A-Za-z-][\w-]*)['\"]?\s*:\s*(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'|`([^`$]*)`|(-?\d*\.?\d+)(?=\s*[,}]))")
KEY = re.compile(r"(?:^|[{,])\s*(?:['\"]([^'\"]+)['\"]|([A-Za-z_$][\w$-]*))\s*:")
SENSITIVE = re.compile(values.SENSITIVE)
ANGULAR_STYLE = re.compile(r"^\[style\.([\w-]+)(?:\.([\w%]+))?\]$")


def _unquoted(value: str) -> str | None:
    """A static attribute value: quoted, or a string in braces."""
    m = re.fullmatch(r"\{\s*(\"[^\"]*\"|'[^']*'|`[^`$]*`)\s*\}|(\"[^\"]*\"|'[^']*')|([^\s\"'{}]+)", value, re.S)
    if not m:
        return None
    text = m[1] or m[2] or m[3]
    return text if m[3] else text[1:-1]


def style_text(text: str) -> list[tuple[str, str]]:
    pairs = [part.split(":", 1) for part in text.split(";") if ":" in part]
    return [(a.strip(), b.strip()) for a, b in pairs if a.strip() and b.strip()]


def style_object(text: str) -> list[tuple[str, str]]:
    """Static entries of an object literal, names in kebab case; numbers as they stand."""
    found = [(m[1], next(x for x in m.groups()[1:] if x is not None)) for m in PAIR.finditer(text)]
    return [(re.sub("([A-Z])", r"-\1", name).lower(), value.strip()) for name, value in found]


def class_strings(text: str) -> list[str]:
    """Class texts in an expression: strings, static parts of templates and the keys of objects."""
    out = []
    for m in STRINGS.finditer(text):
        value = next(x for x in m.groups() if x is not None)
        out += [p for p in re.split(r"\$\{[^}]*\}", value) if p.strip()] if m[3] is not None else [value]
    keys = [a or b for a, b in KEY.findall(text)] if text.lstrip().startswith("{") else []
    return [*dict.fromkeys([*(o for o in out if o not in keys), *keys])]


def bindings(fact: dict, kind: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Inline declarations and class texts of one attribute."""
    name, value = fact["name"], fact["value"] or ""
    static = _unquoted(value)
    inner = (static if static is not None else value.strip("\"'")).strip()
    if kind == "jsx":
        if name == "style" and re.match(r"\{\s*\{", value):
            return style_object(value[1:-1].strip()), []
        return [], (([static] if static is not None else class_strings(value[1:-1].strip())) if name in ("className", "class") else [])
    if name == "style" and static is not None and "{" not in inner:
        return style_text(inner), []
    if name == "class" and static is not None:
        return [], [inner]
    if kind == "vue" and name in (":style", "v-bind:style"):
        return (style_object(inner) if inner.startswith("{") else []), []
    if (kind == "vue" and name in (":class", "v-bind:class")) or (kind == "angular" and name in ("[class]", "[ngClass]")):
        return [], class_strings(inner)
    if kind == "angular" and name == "[ngStyle]":
        return style_object(inner), []
    if kind == "angular" and (m := ANGULAR_STYLE.match(name)):
        number, text = re.fullmatch(r"-?\d*\.?\d+", inner), re.fullmatch(r"'([^']*)'", inner)
        return ([(m[1], inner + m[2])] if number and m[2] else [(m[1], text[1])] if text else []), []
    if kind == "svelte" and name.startswith("style:") and static is not None:
        return [(name[6:], inner)], []
    if kind == "svelte" and name.startswith("class:"):
        return [], [name[6:]]
    return [], []


def _tags(text: str, kind: str, raw: str | None = None, shift: int = 0) -> Iterator[dict]:
    for fact in scan.tag_facts(text, kind == "jsx", shift):
        if kind == "jsx":
            yield fact
        if fact["fact"] == "attr":
            decls, classes = bindings(fact, kind)
            here = {"line": fact["line"], "col": fact["col"]}
            for seq, (prop, value) in enumerate(decls):
                yield {"fact": "decl", "origin": "inline", "name": prop.lower() if not prop.startswith("--") else prop, "value": value, "seq": seq, **here}
            yield from ({"fact": "class", "value": c, **here} for c in classes)


BLOCK = re.compile(r"<(style|script|template)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)


def _component_file(text: str, kind: str) -> Iterator[dict]:
    """Vue and Svelte files: style blocks by their language, and the markup with scripts and styles blanked."""
    markup, unit = text, 0
    for m in BLOCK.finditer(text):
        name = m[1].lower()
        if name == "style":
            unit += 1
            lang = (re.search(r"lang\s*=\s*[\"']?(\w+)", m[2]) or ["", "css"])[1].lower()
            shift = text.count("\n", 0, m.start(3))
            yield from ({**f, "unit": unit} for f in scan.style_facts(m[3], lang if lang in ("scss", "less") else "css", shift))
        if name in ("style", "script"):
            markup = markup[: m.start()] + re.sub(r"[^\n]", " ", m.group()) + markup[m.end() :]
    yield from _tags(markup, kind)


def _angular(text: str) -> Iterator[dict]:
    """Inline styles and template of a class decorated as a component."""
    decorated = re.search(r"@Component\s*\(", text)
    if not decorated:
        return
    body = text[decorated.end() - 1 : scan.balanced(text, decorated.end() - 1)]
    base = decorated.end() - 1
    unit = 0
    if styles := re.search(r"\bstyles\s*:\s*(\[|(?=[`'\"]))", body):
        end = scan.balanced(body, styles.end() - 1) if styles[1] else len(body)
        for m in STRINGS.finditer(body, styles.end(), end):
            unit += 1
            at = base + m.start() + 1
            yield from ({**f, "unit": unit} for f in scan.style_facts(next(x for x in m.groups() if x is not None), "scss", text.count("\n", 0, at)))
            if not styles[1]:
                break
    if (template := re.search(r"\btemplate\s*:\s*(?=[`'\"])", body)) and (m := STRINGS.match(body, template.end())) and "${" not in m.group():
        yield from _tags(next(x for x in m.groups() if x is not None), "angular", shift=text.count("\n", 0, base + m.start() + 1))


def _surface(text: str) -> Iterator[dict]:
    """The leading directive of a script, and its raw lines that give a name a literal."""
    if m := re.match(r"\s*[\"'](use \w+)[\"']", text):
        yield {"fact": "directive", "value": m[1], "line": 1, "col": 0}
    if "console" in text and SENSITIVE.search(text):  # the only rule that reads tokens is about what is logged
        yield {"fact": "tokens", "value": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "structure": list(scan.tokens(text)), "line": 1, "col": 0}
    for number, line in enumerate(text.split("\n"), 1):
        if re.search(r"[:=]\s*[\"'`]", line):
            yield {"fact": "source", "value": line, "line": number, "col": 0}


PARSERS: dict[str, Callable[[str], Iterator[dict]]] = {
    **{lang: lambda t, lang=lang: scan.style_facts(t, lang) for lang in ("css", "scss", "less")},
    "jsx": lambda t: [*_surface(t), *scan.script_facts(t), *_tags(t, "jsx")],
    "vue": lambda t: _component_file(t, "vue"),
    "svelte": lambda t: _component_file(t, "svelte"),
    "angular": _angular,
    "angular-template": lambda t: _tags(t, "angular"),
    **{d: lambda t, d=d: _tags(scan.without_template_code(t, d), d) for d in ("blade", "jinja2", "erb", "twig")},
}


def register_parser(kind: str, parser: Callable[[str], Iterator[dict]]) -> None:
    """Adds or replaces a parser: a function from a text to facts."""
    PARSERS[kind] = parser


def parseable(sources: DataFrame) -> DataFrame:
    """file, content, kind of the files of sources(file, content) that have a parser."""
    return sources.select("file", "content", kind_of(F.col("file")).alias("kind")).where(F.col("kind").isin(*PARSERS))


def parse(sources: DataFrame) -> DataFrame:
    """Facts of every file of sources(file, content) that has a parser. A file that cannot be read gives one fact `error` and no other."""
    return parse_as_kind(parseable(sources))


def parse_as_kind(sources: DataFrame) -> DataFrame:
    """Facts of sources(file, content, kind); what they are depends on content and kind alone."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, kinds = (batch.column(c).to_pylist() for c in ("content", "kind"))
            texts: dict[tuple, int] = {}  # copies in a batch are parsed once
            number = np.array([texts.setdefault(text, len(texts)) for text in zip(contents, kinds, strict=True)], np.int64)
            columns: dict[str, list] = {name: [] for name in NAMES if name != "file"}
            puts = [(name, columns[name].append, DEFAULTS.get(name)) for name in columns if name not in ("kind", "seq")]
            sizes = []
            for content, kind in texts:
                try:
                    found = list(parsers[kind](content or ""))
                except Exception as error:  # one broken file must not end the scan
                    found = [{"fact": "error", "value": str(error), "line": 1, "col": 1}]
                sizes.append(len(found))
                columns["kind"] += [kind] * len(found)
                columns["seq"] += [f.get("seq", seq) for seq, f in enumerate(found)]
                for name, put, default in puts:
                    for f in found:
                        put(f.get(name, default))
            each = pa.RecordBatch.from_arrays([pa.array(columns[name], TYPES[kind]) for name, kind in FIELDS if name != "file"], names=list(columns))
            sizes = np.array(sizes, np.int64)
            first, own = np.cumsum(sizes) - sizes, sizes[number]
            ends, at = np.cumsum(own), 0
            while at < len(own):  # a batch of facts has FACTS_AT_ONCE of them, or those of one file
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FACTS_AT_ONCE, side="right")))
                files = np.repeat(np.arange(at, to), own[at:to])
                rows = each.take(pa.array(np.arange(len(files)) + np.repeat(first[number[at:to]] - (np.cumsum(own[at:to]) - own[at:to]), own[at:to])))
                yield pa.RecordBatch.from_arrays([rows.column(name) if name != "file" else batch.column("file").take(pa.array(files)) for name in NAMES], names=NAMES)
                at = to

    return sources.select("file", "content", "kind").mapInArrow(run, FACTS)


def stored(facts: DataFrame) -> DataFrame:
    """facts, written to the shared folder by fact and read again, so that each rule reads the facts it asks for and no file is parsed twice."""
    spark = facts.sparkSession
    path = scratch_folder(spark, "facts")
    facts.write.partitionBy("fact").parquet(path)
    return spark.read.schema(FACTS).parquet(path)
