"""Configuration: schema with defaults, search upwards, and a writer that keeps other keys. JSON only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from inkstone.sources.files import IGNORED


@dataclass(frozen=True)
class Tokens:
    colors: dict[str, str] = field(default_factory=dict)
    spacing: list[float] = field(default_factory=list)
    font_sizes: list[float] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    font_families: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Config:
    tokens: Tokens = Tokens()
    rules: dict[str, str] = field(default_factory=dict)
    wcag_level: str = "AA"
    ignore: tuple[str, ...] = IGNORED
    baseline_enabled: bool = False
    baseline_path: str = ".inkstone-baseline.json"
    plan: str = "full"


def from_dict(data: dict) -> Config:
    """A checked Config; the first fault found is raised as ValueError."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    tokens = data.get("tokens")
    need(isinstance(tokens, dict), "tokens: an object is required")
    need(isinstance(tokens.get("colors"), dict) and all(isinstance(v, str) for v in tokens["colors"].values()), "tokens.colors: a map of strings is required")
    for name in ("spacing", "fontSizes", "radii"):
        need(isinstance(tokens.get(name), list) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in tokens[name]), f"tokens.{name}: a list of numbers is required")
    need(isinstance(tokens.get("fontFamilies"), list) and all(isinstance(v, str) for v in tokens["fontFamilies"]), "tokens.fontFamilies: a list of strings is required")
    rules = data.get("rules")
    need(isinstance(rules, dict) and all(v in ("off", "warn", "error") for v in rules.values()), "rules: a map to off, warn or error is required")
    level = (data.get("wcag") or {}).get("level", "AA")
    need(level in ("AA", "AAA"), "wcag.level: AA or AAA")
    ignore = data.get("ignore", list(IGNORED))
    need(isinstance(ignore, list) and all(isinstance(g, str) for g in ignore), "ignore: a list of globs")
    baseline = data.get("baseline") or {}
    path = baseline.get("path", Config.baseline_path)
    need(isinstance(path, str) and not PurePosixPath(path).is_absolute() and ".." not in PurePosixPath(path).parts, "baseline.path: a relative path without ..")
    t = Tokens(tokens["colors"], tokens["spacing"], tokens["fontSizes"], tokens["radii"], tokens["fontFamilies"])
    return Config(t, rules, level, tuple(ignore), bool(baseline.get("enabled", False)), path)


def load(start: str | Path, names: tuple[str, ...] = ("inkstone.config.json", ".inkstonerc.json", ".inkstonerc")) -> tuple[Config, Path]:
    """The nearest configuration at or above a folder, and the folder that it lies in."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        for name in names:
            if (file := folder / name).is_file():
                try:
                    return from_dict(json.loads(file.read_text())), folder
                except ValueError as error:
                    raise ValueError(f'Invalid config at "{file}": {error}') from error
    raise FileNotFoundError(f"no configuration at or above {at}")


def set_baseline_enabled(file: str | Path, enabled: bool) -> None:
    data = json.loads(Path(file).read_text())
    data["baseline"] = {**(data.get("baseline") or {}), "enabled": enabled}
    Path(file).write_text(json.dumps(data, indent=2) + "\n")


def draft(tokens: Tokens, severity: str = "warn") -> dict:
    """A configuration for extracted tokens; font families are reduced to the first of their list."""
    design = ("no-hardcoded-color", "no-arbitrary-spacing", "no-arbitrary-font-size", "no-unauthorized-font-family", "no-arbitrary-radius", "enforce-contrast")
    a11y = ("no-img-without-alt", "no-div-button", "no-empty-button", "no-missing-form-label", "no-positive-tabindex", "no-autofocus")
    families = [f.split(",")[0].strip().strip("'\"") for f in tokens.font_families]
    return {
        "tokens": {"colors": tokens.colors, "spacing": tokens.spacing, "fontSizes": tokens.font_sizes, "radii": tokens.radii, "fontFamilies": list(dict.fromkeys(families))},
        "rules": {**dict.fromkeys(design, severity), **dict.fromkeys(a11y, "warn")},
        "wcag": {"level": "AA"},
        "ignore": list(IGNORED),
    }
