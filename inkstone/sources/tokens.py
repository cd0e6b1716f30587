"""Token sources: exported themes, design-token files, style-sheet variables and the code itself, ranked by confidence.

Token sets are configuration: they are read and merged on the driver; only the code scan runs over the sources.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import color, values
from inkstone.operators.extract import draft_tokens
from inkstone.sources.config import Tokens

# Places and names that the sources are looked for under, and what their names say.
THEME_FILES = ("tailwind.theme.json", "tailwind.config.json")
# Where token files are looked for by name, folders all of whose JSON files are token files, and the configuration that names more.
TOKEN_DIRS, TOKEN_FILES = ("", "src", "tokens", "design-tokens"), ("tokens.json", "tokens.json5", "design-tokens.json")
TOKEN_FOLDERS, TOKEN_CONFIG = ("tokens", "design-tokens"), "style-dictionary.config.json"
VARIABLE_DIRS = ("", "src", "src/styles", "src/css", "styles", "css")
VARIABLE_FILES = ("variables.css", "tokens.css", "vars.css", "theme.css", "global.css", "globals.css", "app.css", "index.css", "_variables.scss", "_tokens.scss")
SKIPPED_COLORS = ("transparent", "inherit", "current", "currentColor")
LEAST_VARIABLES = 3
RESERVED = ("$value", "value", "$type", "type", "$description", "description")


@dataclass(frozen=True)
class Detected:
    source: str
    confidence: float
    file: str | None


def to_px(value) -> float | None:
    """Pixels of a number, or of a px, rem or em text."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    m = re.fullmatch(r"\s*(-?\d*\.?\d+)\s*(px|rem|em)?\s*", str(value))
    return float(m[1]) * (16 if m[2] in ("rem", "em") else 1) if m else None


def scale(items) -> list[float]:
    return sorted({v for v in map(to_px, items) if v is not None})


def from_theme(theme: dict) -> Tokens:
    """Tokens of an exported utility-class theme: `extend` wins, colours are flattened one level, DEFAULT is the bare name."""
    base = theme.get("theme", theme)
    merged = {k: {**(base.get(k) or {}), **((base.get("extend") or {}).get(k) or {})} for k in ("colors", "spacing", "fontSize", "borderRadius", "fontFamily")}
    colors: dict[str, str] = {}
    for name, value in merged["colors"].items():
        if name in SKIPPED_COLORS:
            continue
        if isinstance(value, str):
            colors[name] = value
        elif isinstance(value, dict):
            colors |= {name if k == "DEFAULT" else f"{name}-{k}": v for k, v in value.items() if isinstance(v, str)}
    first = lambda v: v[0] if isinstance(v, list) and v else v
    families = [first(v) if isinstance(v, list) else str(v).split(",")[0].strip() for v in merged["fontFamily"].values()]
    return Tokens(colors, scale(merged["spacing"].values()), scale(map(first, merged["fontSize"].values())), scale(merged["borderRadius"].values()), list(dict.fromkeys(families)))


def walk_tokens(tree: dict) -> dict[str, tuple[str, object]]:
    """path -> (type, value) of every typed token of a token tree, the type inherited from groups."""
    found: dict[str, tuple[str, object]] = {}
    todo: list[tuple[str, dict, str | None]] = [("", tree, None)]
    while todo:
        path, node, kind = todo.pop()
        kind = node.get("$type", node.get("type") if isinstance(node.get("type"), str) else None) or kind
        value = node.get("$value", node.get("value"))
        if value is not None and not isinstance(value, dict):
            if kind:
                found[path] = (kind, value)
            continue
        todo += [(f"{path}.{k}" if path else k, v, kind) for k, v in reversed(list(node.items())) if k not in RESERVED and isinstance(v, dict)]
    return found


def resolve_aliases(tokens: dict[str, tuple[str, object]]) -> dict[str, tuple[str, object]]:
    """Tokens with `{a.b}` followed to a value; circles and unknown names are left out."""
    out = {}
    for path, (kind, value) in tokens.items():
        seen = {path}
        while isinstance(value, str) and (m := re.fullmatch(r"\{([^{}]+)\}", value.strip())):
            if m[1] in seen or m[1] not in tokens:
                value = None
                break
            seen.add(m[1])
            value = tokens[m[1]][1]
        if value is not None:
            out[path] = (kind, value)
    return out


def dimension_of(name: str) -> str:
    for pattern, kind in ((r"spac|gap|margin|padding", "spacing"), (r"font|text|size", "fontSize"), (r"radi|round|corner", "radius")):
        if re.search(pattern, name, re.I):
            return kind
    return "spacing"


def from_token_tree(tree: dict) -> Tokens:
    """Tokens of a design-token file; font families are stored whole."""
    colors, lists, families = {}, {"spacing": [], "fontSize": [], "radius": []}, []
    for path, (kind, value) in resolve_aliases(walk_tokens(tree)).items():
        if kind == "color":
            colors[path.replace(".", "-")] = str(value)
        elif kind == "fontFamily":
            families.append(", ".join(value) if isinstance(value, list) else str(value))
        elif kind in ("dimension", "spacing", "borderRadius", "fontSize", "sizing") and (px := to_px(value)) is not None:
            lists[{"spacing": "spacing", "borderRadius": "radius", "fontSize": "fontSize"}.get(kind) or dimension_of(path)].append(px)
    return Tokens(colors, scale(lists["spacing"]), scale(lists["fontSize"]), scale(lists["radius"]), list(dict.fromkeys(families)))


def classify_variables(declared: DataFrame) -> DataFrame:
    """name, value, category for custom properties and variables, by value and then by name."""
    name, value = F.regexp_replace("name", r"^(?:--|[$@])", ""), F.col("value")
    by_name = F.when(name.rlike("(?i)radius|round|corner"), "radius").when(name.rlike("(?i)font|text|fs|size"), "fontSize").when(name.rlike("(?i)space|spacing|gap|(?:^|-)sp(?:-|$)"), "spacing")
    category = F.when(color.normalise(value).isNotNull() & values.has_color(value), "color").when(values.px_of(value).isNotNull(), by_name).when(name.rlike("(?i)font-?family|font$"), "fontFamily")
    return declared.select(name.alias("name"), "value", category.alias("category")).where("category is not null")


def variable_files() -> list[str]:
    """The files, relative to a project, that variables are looked for in, in their order."""
    return [f"{d}/{n}" if d else n for d in VARIABLE_DIRS for n in VARIABLE_FILES]


def best_variables(facts: DataFrame, root: str = "") -> DataFrame:
    """Declared variables of that one of the variable files which declares most, the first of equals, if it declares three or more."""
    declared = facts.where("fact in ('decl', 'at_rule')").where((F.col("name").startswith("--") & (F.trim("selector") == ":root")) | F.col("name").rlike(r"^[$@]"))
    place = F.array_position(F.array(*[F.lit(f) for f in variable_files()]), values.relative_path(F.col("file"), root))
    placed = declared.withColumn("place", place).where("place > 0")
    best = placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_VARIABLES).orderBy(F.desc("n"), "place").limit(1)
    return placed.join(best, "place", "left_semi").drop("place")


def from_variables(facts: DataFrame, root: str = "") -> Tokens:
    colors, lists, families = {}, {"spacing": [], "fontSize": [], "radius": []}, []
    for r in classify_variables(best_variables(facts, root)).collect():  # one file's variables
        if r["category"] == "color":
            colors[r["name"]] = r["value"]
        elif r["category"] == "fontFamily":
            families.append(r["value"])
        else:
            lists[r["category"]].append(r["value"])
    return Tokens(colors, scale(lists["spacing"]), scale(lists["fontSize"]), scale(lists["radius"]), families)


def _first_file(root: Path, folders: tuple[str, ...], names: tuple[str, ...]) -> Path | None:
    return next((f for d in folders for n in names if (f := root / d / n).is_file()), None)


def _theme_file(root: Path) -> Path | None:
    return _first_file(root, ("",), THEME_FILES)


def _read_object(file: Path) -> dict:
    """A JSON object; nothing for a file that can't be read as one."""
    try:
        found = json.loads(file.read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def token_files(root: Path) -> list[Path]:
    """All token files of a project, sorted: those with a name of TOKEN_FILES or ending in .tokens.json, the JSON files of TOKEN_FOLDERS, and those
    that the patterns under `source` in TOKEN_CONFIG match."""
    found = {f for d in TOKEN_DIRS for n in TOKEN_FILES if (f := root / d / n).is_file()}
    found |= {f for d in TOKEN_DIRS if (root / d).is_dir() for f in (root / d).glob("*.tokens.json") if f.is_file()}
    found |= {f for d in TOKEN_FOLDERS if (root / d).is_dir() for f in (root / d).glob("*.json") if f.is_file()}
    patterns = _read_object(root / TOKEN_CONFIG).get("source", [])
    for pattern in [patterns] if isinstance(patterns, str) else patterns if isinstance(patterns, list) else []:
        if isinstance(pattern, str) and pattern and not Path(pattern).is_absolute():
            found |= {f for f in root.glob(pattern.removeprefix("./")) if f.is_file()}
    return sorted(found)


def token_tree(root: Path) -> dict:
    """The token files as one tree, later files over earlier ones by top-level name, so that aliases reach across files."""
    tree: dict = {}
    for file in token_files(root):
        tree |= _read_object(file)
    return tree


def _token_file(root: Path) -> Path | None:
    return next(iter(token_files(root)), None)


DETECTORS: dict[str, tuple[float, Callable[[Path], Path | None]]] = {
    "tailwind": (0.9, _theme_file),
    "tokens": (0.85, _token_file),
    "css-vars": (0.8, lambda root: _first_file(root, VARIABLE_DIRS, VARIABLE_FILES)),
}


def detect(root: str | Path) -> list[Detected]:
    """Sources that a project has, the surest first; the code itself is always one."""
    found = [Detected(name, sure, str(file)) for name, (sure, look) in DETECTORS.items() if (file := look(Path(root)))]
    return sorted([*found, Detected("code", 0.1, None)], key=lambda d: -d.confidence)


def resolve(root: str | Path, facts: DataFrame, source: str | None = None) -> tuple[str, Tokens]:
    """The named source, or the surest one, and its tokens."""
    found = {d.source: d for d in detect(root)}
    name = source or next(iter(found))
    if name not in found:
        raise ValueError(f"no token source {name!r} here; there are {', '.join(found)}")
    file = found[name].file
    if name == "tailwind":
        return name, from_theme(json.loads(Path(file).read_text()))
    if name == "tokens":
        return name, from_token_tree(token_tree(Path(root)))
    return name, from_variables(facts, str(root)) if name == "css-vars" else draft_tokens(facts)
