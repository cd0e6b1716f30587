"""Column functions over colours: normal form, contrast and perceptual distance."""

from __future__ import annotations

import colorsys
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.values import let

# The CSS colour names.
NAMED = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd
blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed
cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9
darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f
darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff
dimgray 696969 dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc
ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4
indianred cd5c5c indigo 4b0082 ivory fffff0 khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6
lightcoral f08080 lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a
lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00
limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db
mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970
mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500
orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9
peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6 purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1
saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd
slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347
turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
"""


def named_colors() -> dict[str, str]:
    parts = NAMED.split()
    return {name: f"#{code}" for name, code in zip(parts[::2], parts[1::2], strict=True)}


def _hex2(channel: Column) -> Column:
    whole = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(channel + 0.5)))
    return F.lpad(F.lower(F.hex(whole.cast("long"))), 2, "0")


def _functional(text: Column) -> Column:
    """Normal form of rgb() and hsl(); each step is bound once."""
    numbers = F.slice(F.regexp_extract_all(text, F.lit(r"-?\d*\.?\d+%?"), F.lit(0)), 1, 3)
    plain = F.transform(numbers, lambda n: F.struct(F.regexp_replace(n, "%", "").try_cast("double").alias("v"), n.endswith("%").alias("share")))

    def rgb(parts: Column) -> Column:
        channels = F.transform(parts, lambda p: F.when(p["share"], p["v"] * 2.55).otherwise(p["v"]))
        return F.concat(F.lit("#"), F.array_join(F.transform(channels, _hex2), ""))

    def hsl(parts: Column) -> Column:
        def mixed(x: Column) -> Column:
            hue, chroma, second, zero = x["hue"], x["chroma"], x["second"], F.lit(0.0)
            red = F.when((hue < 1) | (hue >= 5), chroma).when((hue < 2) | (hue >= 4), second).otherwise(zero)
            green = F.when((hue >= 1) & (hue < 3), chroma).when(hue < 4, second).otherwise(zero)
            blue = F.when((hue >= 3) & (hue < 5), chroma).when(hue >= 2, second).otherwise(zero)
            green = F.when(hue >= 4, zero).otherwise(green)
            return F.concat(F.lit("#"), F.array_join(F.transform(F.array(red, green, blue), lambda c: _hex2((c + x["base"]) * 255)), ""))

        def second(x: Column) -> Column:
            return F.struct(x["hue"].alias("hue"), x["chroma"].alias("chroma"), (x["chroma"] * (1 - F.abs(F.pmod(x["hue"], F.lit(2.0)) - 1))).alias("second"), (x["light"] - x["chroma"] / 2).alias("base"))

        light = parts[2]["v"] / 100
        first = F.struct((F.pmod(parts[0]["v"], F.lit(360.0)) / 60).alias("hue"), ((1 - F.abs(2 * light - 1)) * parts[1]["v"] / 100).alias("chroma"), light.alias("light"))
        return let(first, lambda x: let(second(x), mixed))

    return let(plain, lambda parts: F.when(F.size(parts) < 3, None).when(text.startswith("hsl"), hsl(parts)).otherwise(rgb(parts)))


def normalise(value: Column, names: bool = True) -> Column:
    """`#rrggbb` of a hex, rgb(), hsl() or named colour, alpha dropped; null for anything else."""
    text = F.lower(F.trim(value))
    short = F.concat(F.lit("#"), *[F.repeat(F.substring(text, i, 1), 2) for i in (2, 3, 4)])
    out = F.when(text.rlike("^#[0-9a-f]{3,4}$"), short).when(text.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(text, 1, 7)).when(text.rlike(r"^(?:rgb|hsl)a?\s*\([^)]+\)$"), _functional(text))
    if names:
        table = F.expr("map(" + ", ".join(f"'{name}', '{code}'" for name, code in named_colors().items()) + ")")
        out = F.when(text.rlike("^[a-z]+$"), F.try_element_at(table, text)).otherwise(out)
    return out


def channel(color: Column, i: int) -> Column:
    """Channel i of `#rrggbb`, 0 to 1."""
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("double") / 255


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(color: Column) -> Column:
    r, g, b = (linear(channel(color, i)) for i in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast ratio, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


#: D65 with 2 degree observer.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def with_lab(df: DataFrame, color: str, prefix: str) -> DataFrame:
    """Adds {prefix}_l, _a, _b of a `#rrggbb` column."""
    df = df.withColumns({f"{prefix}__{k}": linear(channel(F.col(color), i)) for i, k in enumerate("rgb")})
    curve = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    xyz = [sum((F.col(f"{prefix}__{k}") * m for k, m in zip("rgb", row, strict=True)), F.lit(0.0)) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    df = df.withColumns({f"{prefix}__f{k}": curve(v) for k, v in zip("xyz", xyz, strict=True)})
    f = {k: F.col(f"{prefix}__f{k}") for k in "xyz"}
    df = df.withColumns({f"{prefix}_l": 116 * f["y"] - 16, f"{prefix}_a": 500 * (f["x"] - f["y"]), f"{prefix}_b": 200 * (f["y"] - f["z"])})
    return df.drop(*[f"{prefix}__{k}" for k in ("r", "g", "b", "fx", "fy", "fz")])


def normalised(value: str) -> str | None:
    """What normalise gives, for token sets on the driver."""
    text = value.strip().lower()
    if re.fullmatch("#[0-9a-f]{3,4}", text):
        return "#" + "".join(c * 2 for c in text[1:4])
    if re.fullmatch("#(?:[0-9a-f]{6}|[0-9a-f]{8})", text):
        return text[:7]
    if not re.fullmatch(r"(?:rgb|hsl)a?\s*\([^)]+\)", text):
        return named_colors().get(text)
    numbers = re.findall(r"-?\d*\.?\d+%?", text)[:3]
    if len(numbers) < 3:
        return None
    plain = [float(n.rstrip("%")) for n in numbers]
    if text.startswith("hsl"):
        channels = [c * 255 for c in colorsys.hls_to_rgb(plain[0] / 360 % 1, plain[2] / 100, plain[1] / 100)]
    else:
        channels = [v * 2.55 if n.endswith("%") else v for n, v in zip(numbers, plain, strict=True)]
    return "#" + "".join(f"{min(255, max(0, math.floor(c + 0.5))):02x}" for c in channels)


def lab(color: str) -> tuple[float, float, float]:
    """Lab of `#rrggbb`, for token sets on the driver."""
    plain = [int(color[k : k + 2], 16) / 255 for k in (1, 3, 5)]
    rgb = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in plain]
    x, y, z = (sum(c * m for c, m in zip(rgb, row, strict=True)) / w for row, w in zip(TO_XYZ, WHITE, strict=True))
    fx, fy, fz = (math.cbrt(t) if t > 216 / 24389 else (24389 / 27 * t + 16) / 116 for t in (x, y, z))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def with_delta_e(df: DataFrame, p: str, q: str, name: str) -> DataFrame:
    """Adds the CIEDE2000 distance of the lab columns with prefixes p and q, in stages, so that no term is written out twice."""
    keep = df.columns
    c = F.col
    mean_c7 = F.pow((F.sqrt(c(f"{p}_a") ** 2 + c(f"{p}_b") ** 2) + F.sqrt(c(f"{q}_a") ** 2 + c(f"{q}_b") ** 2)) / 2, 7)
    df = df.withColumn("g__", 0.5 * (1 - F.sqrt(mean_c7 / (mean_c7 + 25.0**7))))
    df = df.withColumns({"a1__": (1 + c("g__")) * c(f"{p}_a"), "a2__": (1 + c("g__")) * c(f"{q}_a")})
    hue = lambda b, a: F.when((b == 0) & (a == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    df = df.withColumns({"c1__": F.sqrt(c("a1__") ** 2 + c(f"{p}_b") ** 2), "c2__": F.sqrt(c("a2__") ** 2 + c(f"{q}_b") ** 2), "h1__": hue(c(f"{p}_b"), c("a1__")), "h2__": hue(c(f"{q}_b"), c("a2__"))})
    diff, grey = c("h2__") - c("h1__"), c("c1__") * c("c2__") == 0
    turn = F.when(grey, 0.0).when(F.abs(diff) <= 180, diff).when(diff > 180, diff - 360).otherwise(diff + 360)
    total = c("h1__") + c("h2__")
    mean_h = F.when(grey, total).when(F.abs(diff) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    df = df.withColumns({"dl__": c(f"{q}_l") - c(f"{p}_l"), "dc__": c("c2__") - c("c1__"), "dh__": 2 * F.sqrt(c("c1__") * c("c2__")) * F.sin(F.radians(turn / 2)), "lm__": (c(f"{p}_l") + c(f"{q}_l")) / 2, "cm__": (c("c1__") + c("c2__")) / 2, "hm__": mean_h})
    cos = lambda k, shift: F.cos(F.radians(k * c("hm__") + shift))
    square = (c("lm__") - 50) ** 2
    cm7 = F.pow(c("cm__"), 7)
    df = df.withColumns(
        {
            "t__": 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63),
            "sl__": 1 + 0.015 * square / F.sqrt(20 + square),
            "rt__": -2 * F.sqrt(cm7 / (cm7 + 25.0**7)) * F.sin(F.radians(60 * F.exp(-(((c("hm__") - 275) / 25) ** 2)))),
        }
    )
    df = df.withColumns({"l__": c("dl__") / c("sl__"), "k__": c("dc__") / (1 + 0.045 * c("cm__")), "o__": c("dh__") / (1 + 0.015 * c("cm__") * c("t__"))})
    distance = F.sqrt(c("l__") ** 2 + c("k__") ** 2 + c("o__") ** 2 + c("rt__") * c("k__") * c("o__"))
    return df.select(*keep, distance.alias(name))


def delta_e(p: tuple[float, float, float], q: tuple[float, float, float]) -> float:
    """The same distance of two Lab triples, for token sets on the driver."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    g = 0.5 * (1 - math.sqrt((m := ((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2) ** 7) / (m + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = math.hypot(a1, b1), math.hypot(a2, b2)
    h1, h2 = (math.degrees(math.atan2(b, a)) % 360 if a or b else 0.0 for a, b in ((a1, b1), (a2, b2)))
    diff = h2 - h1
    turn = 0.0 if c1 * c2 == 0 else diff if abs(diff) <= 180 else diff - 360 if diff > 180 else diff + 360
    total = h1 + h2
    hm = total if c1 * c2 == 0 else total / 2 if abs(diff) <= 180 else (total + 360) / 2 if total < 360 else (total - 360) / 2
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    cos = lambda k, s: math.cos(math.radians(k * hm + s))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    rt = -2 * math.sqrt(cm**7 / (cm**7 + 25.0**7)) * math.sin(math.radians(60 * math.exp(-(((hm - 275) / 25) ** 2))))
    dl = (l2 - l1) / (1 + 0.015 * (lm - 50) ** 2 / math.sqrt(20 + (lm - 50) ** 2))
    dc, dh = (c2 - c1) / (1 + 0.045 * cm), 2 * math.sqrt(c1 * c2) * math.sin(math.radians(turn / 2)) / (1 + 0.015 * cm * t)
    return math.sqrt(dl**2 + dc**2 + dh**2 + rt * dc * dh)


#: No two colours whose lightness differs by more than this many times their distance exist: the divisor of the lightness term is 1.75 at most.
LIGHTNESS_SPAN = 1.75


def delta_es(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """delta_e of the rows of two arrays of Lab triples."""
    (l1, a1, b1), (l2, a2, b2) = p.T, q.T
    m = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * np.sqrt(m / (m + 25.0**7))
    a1, a2 = a1 * g, a2 * g
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    grey, diff, total = c1 * c2 == 0, h2 - h1, h1 + h2
    turn = np.where(grey, 0.0, np.where(np.abs(diff) <= 180, diff, np.where(diff > 180, diff - 360, diff + 360)))
    hm = np.where(grey, total, np.where(np.abs(diff) <= 180, total / 2, np.where(total < 360, (total + 360) / 2, (total - 360) / 2)))
    square, cm = ((l1 + l2) / 2 - 50) ** 2, (c1 + c2) / 2
    cos = lambda k, s: np.cos(np.radians(k * hm + s))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    rt = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    dl = (l2 - l1) / (1 + 0.015 * square / np.sqrt(20 + square))
    dc, dh = (c2 - c1) / (1 + 0.045 * cm), 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * cm * t)
    return np.sqrt(dl**2 + dc**2 + dh**2 + rt * dc * dh)


def near_pairs(mine: np.ndarray, heads: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two arrays of Lab triples within near, in order; where rounding could tell, delta_e decides."""
    row, head = np.nonzero(np.abs(mine[:, None, 0] - heads[None, :, 0]) <= LIGHTNESS_SPAN * near)
    off = delta_es(heads[head], mine[row])
    close = off <= near
    for k in np.flatnonzero(np.abs(off - near) < 1e-6):
        close[k] = delta_e(tuple(heads[head[k]].tolist()), tuple(mine[row[k]].tolist())) <= near
    return row[close], head[close]


def apart(colors: np.ndarray, near: float) -> np.ndarray:
    """Those of an array of Lab triples that none of those before them is within near of, taken one after the other."""
    heads, n = np.empty_like(colors), 0
    for mine in colors:
        if not len(near_pairs(mine[None], heads[:n], near)[0]):
            heads[n] = mine
            n += 1
    return heads[:n]
