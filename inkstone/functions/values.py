"""Column functions over style values: classification, lengths, scales, names, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of colour literals, token references and property families.
COLOR = r"(?i)#[0-9a-f]{3,8}\b|rgba?\s*\([^)]+\)|hsla?\s*\([^)]+\)"
TOKEN = r"var\s*\(--|(?<![\w$@-])[$@][A-Za-z_][\w-]*"
SPACING_PROP = r"^(?:(?:margin|padding)(?:-(?:top|right|bottom|left))?|gap|row-gap|column-gap|top|left|right|bottom)$"
RADIUS_PROP = r"^border(?:-(?:top-left|top-right|bottom-left|bottom-right))?-radius$"
COLOR_PROP = (
    r"^(?:color|background(?:-(?:color|image|gradient|attachment|clip|origin|position|repeat|size))?|border(?:-(?:top|right|bottom|left))?(?:-color)?"
    r"|fill|stroke|outline(?:-(?:color|style|width|offset))?)$"
)
VARIABLE_PROP = r"^[$@][A-Za-z_][\w-]*$"
VAR_REF = r"var\(\s*(--[\w-]+)"
UNIT = r"^-?\d*\.?\d+(?:px|rem|em|vh|vw|vmin|vmax|ch|ex|cm|mm|in|pt|pc)$"
NUMBER = r"^(-?\d*\.?\d+)(px|rem|%)$"
SUFFIXES = ("Primary", "Secondary", "Main", "New", "Old", "V2", "Alt", "Custom", "Base", "Wrapper", "Container")
#: Fixed value: names that speak of a secret.
SENSITIVE = r"(?i)token|password|passwd|secret|apikey|api_key|auth|credential|private_?key|session"
SPACING_NEAR, FONT_NEAR, RADIUS_NEAR, COLOR_NEAR = 4.0, 2.0, 2.0, 10.0


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once for a row, however many filters and columns name them: the optimizer neither
    copies an expression past the generator it comes out of, nor moves a filter on it below."""
    for name, value in columns.items():
        df = df.withColumn(name, F.explode(F.array(value)))
    return df


def has_color(value: Column) -> Column:
    return value.rlike(COLOR)


def colors_in(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(COLOR), F.lit(0))


def is_token(value: Column) -> Column:
    return value.rlike(TOKEN)


def var_refs(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(VAR_REF), F.lit(1))


def number_of(value: Column) -> Column:
    """The number of a px, rem or % value, rem as 16 px; null for anything else."""
    text = F.trim(value)
    number = F.regexp_extract(text, NUMBER, 1).try_cast("double")
    return F.when(F.regexp_extract(text, NUMBER, 2) == "rem", number * 16).otherwise(number)


def unit_of(value: Column) -> Column:
    unit = F.regexp_extract(F.trim(value), NUMBER, 2)
    return F.when(unit == "rem", F.lit("px")).when(unit != "", unit)


def px_of(value: Column, rem: bool = True) -> Column:
    """Pixels of a px (and rem) value; null for anything else."""
    return F.when(unit_of(value) == "px", number_of(value) if rem else F.when(~F.trim(value).endswith("rem"), number_of(value)))


def kind_of(prop: Column) -> Column:
    """What a property's plain numbers measure."""
    return F.when(prop.rlike(SPACING_PROP), "spacing").when(prop == "font-size", "fontSize").when(prop.rlike(RADIUS_PROP), "radius").when(prop == "font-family", "fontFamily").when(prop.rlike(COLOR_PROP), "color").otherwise("unknown")


def parse_value(value: Column, prop: Column) -> Column:
    """struct(kind, raw, value, unit, is_token) of one value, by what it holds and then by its property."""
    raw, hint = F.trim(value), kind_of(prop)
    kind = F.when(has_color(raw), "color").when(number_of(raw).isNotNull(), hint).when(is_token(raw), hint).when(hint == "fontFamily", hint).otherwise("unknown")
    plain = ~has_color(raw)
    return F.struct(kind.alias("kind"), raw.alias("raw"), F.when(plain, number_of(raw)).alias("value"), F.when(plain, unit_of(raw)).alias("unit"), (~has_color(raw) & number_of(raw).isNull() & is_token(raw)).alias("is_token"))


def scale(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def in_scale(number: Column, values: list[float]) -> Column:
    return F.array_contains(scale(values), number) if values else F.lit(False)


def nearest(number: Column, values: list[float], most: float) -> Column:
    """The closest scale value within most (inclusive), the smaller of two; null if there is none."""
    if not values:
        return F.lit(None).cast("double")
    best = F.array_min(F.transform(scale(values), lambda s: F.struct(F.abs(number - s).alias("off"), s.alias("v"))))
    return F.when(best["off"] <= most, best["v"])


def number_text(number: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(number.cast("string"))


def first_family(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.split_part(value, F.lit(","), F.lit(1))), r"^['\"]|['\"]$", "")


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "-$1"))


def root_name(name: Column) -> Column:
    """A component's name without its trailing variant words; a name that is only such a word stays."""
    return F.regexp_extract(name, f"^(.+?)(?:{'|'.join(SUFFIXES)})*$", 1)


def text_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / most)


def name_similarity(a: Column, b: Column) -> Column:
    return F.when(F.lower(root_name(a)) == F.lower(root_name(b)), 1.0).otherwise(text_similarity(F.lower(a), F.lower(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def variant_score(name: Column, props: Column, structure: Column) -> Column:
    return 0.3 * name + 0.35 * props + 0.35 * structure


def fingerprint(rule: Column, file: Column, message: Column, index: Column) -> Column:
    """sha1 of the four texts joined by a zero character."""
    return F.sha1(F.concat_ws("\x00", rule, file, message, index.cast("string")).cast("binary"))


def relative_path(file: Column, root: str) -> Column:
    base = root.replace("\\", "/").rstrip("/") + "/"
    posix = F.translate(file, "\\", "/")
    return F.when(posix.startswith(base), F.substring(posix, len(base) + 1, 1 << 30)).otherwise(posix) if root else posix


def repository_id(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def drift_dots(ratio: Column) -> Column:
    return F.when(ratio >= 0.35, 3).when(ratio >= 0.15, 2).when(ratio > 0, 1).otherwise(0)


# Utility classes with a value in brackets.
SPACING_UTILITIES = "p px py pt pr pb pl m mx my mt mr mb ml gap gap-x gap-y space-x space-y inset inset-x inset-y top right bottom left w h min-w max-w min-h max-h".split()
DYNAMIC = r"(?i)\b(calc|var)\s*\("


def class_names(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda c: c != "")


def _brackets(name: Column) -> Column:
    """struct(colon, open, close): 0-based places of the last colon outside brackets, of the first bracket behind it and of its end, -1 for none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(-1).alias("colon"), F.lit(-1).alias("open"), F.lit(-1).alias("close"))

    def step(s: Column, c: Column) -> Column:
        at, depth = s["at"], s["depth"]
        deeper = depth + F.when(c == "[", 1).when((c == "]") & (depth > 0), -1).otherwise(0)
        parts = (c == ":") & (depth == 0)
        opens = (c == "[") & (depth == 0) & (s["open"] < 0)
        closes = (c == "]") & (depth == 1) & (s["open"] >= 0) & (s["close"] < 0)
        return F.struct(
            (at + 1).alias("at"), deeper.alias("depth"), F.when(parts, at).otherwise(s["colon"]).alias("colon"),
            F.when(parts, -1).when(opens, at).otherwise(s["open"]).alias("open"), F.when(parts, -1).when(closes, at).otherwise(s["close"]).alias("close"),
        )

    return F.aggregate(F.split(name, ""), start, step)


def arbitrary_class(name: Column) -> Column:
    """struct(utility, raw, number, category, head, tail) of a class with a value in brackets of any depth: a utility's, or a property's of its own;
    head and tail are what stands around the value. Null for others and for calc() and var()."""

    def cut(begin: Column, end: Column) -> Column:
        return F.substring(name, begin + 1, end - begin)

    def read(b: Column) -> Column:
        size = F.length(name)
        end = size - F.when(name.endswith("!"), 1).otherwise(0)
        before = F.regexp_replace(cut(b["colon"] + 1, b["open"]), "^!?-?", "")
        own = (before == "") & F.substring(name, end, 1).eqNullSafe("]")
        inner = F.position(F.lit(":"), name, b["open"] + 1) - 1  # between a property and its value
        at = F.when(own, inner + 1).otherwise(b["open"] + 1)
        to = F.when(own, end - 1).otherwise(b["close"])
        utility = F.when(own, F.trim(cut(b["open"] + 1, inner))).otherwise(F.regexp_replace(before, "-$", ""))
        fields = F.struct(own.alias("property"), utility.alias("utility"), F.trim(cut(at, to)).alias("raw"), cut(F.lit(0), at).alias("head"), cut(to, size).alias("tail"))
        return F.when((b["open"] >= 0) & F.when(own, (inner > b["open"]) & (inner < to)).otherwise(b["close"] >= 0), fields)

    def measured(x: Column) -> Column:
        return let(F.struct(x["property"].alias("property"), x["utility"].alias("utility"), x["raw"].alias("raw"), x["head"].alias("head"), x["tail"].alias("tail"), number_of(x["raw"]).alias("number"), has_color(x["raw"]).alias("colored")), judged)

    def judged(x: Column) -> Column:
        utility, raw, number, colored = x["utility"], x["raw"], x["number"], x["colored"]
        by_name = F.when(utility.startswith("rounded"), "radius").when(utility.isin(*SPACING_UTILITIES), "spacing").when(colored, "color").when((utility == "text") & number.isNotNull(), "fontSize").otherwise("other")
        by_property = F.when(colored, "color").when(utility.rlike(RADIUS_PROP), "radius").when(utility.rlike(SPACING_PROP), "spacing").when(utility == "font-size", "fontSize").otherwise("other")
        category = F.when(x["property"], by_property).otherwise(by_name)
        return F.when((raw != "") & ~raw.rlike(DYNAMIC), F.struct(utility.alias("utility"), raw.alias("raw"), number.alias("number"), category.alias("category"), x["head"].alias("head"), x["tail"].alias("tail")))

    return F.when(name.contains("["), let(let(_brackets(name), read), measured))


def offset_line(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def offset_column(text: Column, offset: Column) -> Column:
    """0-based column of a 0-based character offset."""
    return F.length(F.element_at(F.split(F.substring(text, F.lit(1), offset), "\n"), -1))
