"""The per-file rules: each is a query over the fact table that returns violations with the columns of schema.VIOLATIONS.

Rules that read declarations see real blocks and inline ones alike; markup and script rules see component files (kind jsx) only.
Rule ids and their defaults are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import color, values
from inkstone.schema import COLUMNS
from inkstone.sources.config import Config

Rule = Callable[[DataFrame, Config], DataFrame]

# id, category, severity, description
CATALOG = [
    ("no-hardcoded-color", "design", "error", "Colour literals stand where a token belongs"),
    ("no-arbitrary-spacing", "design", "error", "Spacing is off the scale"),
    ("no-arbitrary-font-size", "design", "error", "Font size is off the scale"),
    ("no-unauthorized-font-family", "design", "error", "Font family is not a token"),
    ("no-arbitrary-radius", "design", "warning", "Corner radius is off the scale"),
    ("enforce-contrast", "design", "error", "Text and background are too close"),
    ("no-tailwind-arbitrary", "design", "warning", "Utility class holds a value that is no token"),
    ("no-img-without-alt", "a11y", "error", "Image has no alternative text"),
    ("no-div-button", "a11y", "warning", "Clickable element is no button"),
    ("no-empty-button", "a11y", "error", "Button has no name"),
    ("no-missing-form-label", "a11y", "error", "Form field has no label"),
    ("no-positive-tabindex", "a11y", "warning", "Tab order is forced"),
    ("no-autofocus", "a11y", "warning", "Focus is taken on load"),
    ("no-xss-dangerous", "security", "error", "Raw markup is injected unsanitised"),
    ("no-env-in-client", "security", "error", "Private environment value in client code"),
    ("no-console-sensitive", "security", "warning", "Sensitive value is logged"),
    ("no-hardcoded-credentials", "security", "error", "Credential stands in the source"),
    ("no-todo-without-ticket", "quality", "warning", "Open task names no ticket"),
    ("no-magic-numbers", "quality", "warning", "Unnamed number"),
    ("no-oversized-component", "quality", "warning", "Component is too long"),
    ("no-console-log", "quality", "warning", "Left-over log call"),
    ("no-inline-styles", "quality", "warning", "Inline style object"),
    ("no-dead-token", "quality", "warning", "Token is never used"),
    ("spacing-near-token", "design", "warning", "Spacing is close to a token"),
    ("variant-sprawl", "quality", "warning", "Components are near duplicates"),
]
DEFAULTS = {rule: severity for rule, _, severity, _ in CATALOG}
CATEGORY = {rule: category for rule, category, _, _ in CATALOG}
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Registers a rule, also a user's own."""

    def put(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return put


def violation(rows: DataFrame, name: str, message: Column, suggested: Column | None = None, old: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(name).alias("rule_id"), F.lit(DEFAULTS.get(name, "warning")).alias("severity"), message.alias("message"), "file", "line", "col", (none if suggested is None else suggested).alias("suggested"), (none if old is None else old).alias("old_value"))


def facts_of(facts: DataFrame, fact: str, kind: str | None = None) -> DataFrame:
    found = facts.where(F.col("fact") == fact)
    return found.where(F.col("kind") == kind) if kind else found


def parts_of(decls: DataFrame, slash: bool = False) -> DataFrame:
    """One row for each white-space separated part of a declaration's value."""
    value = F.regexp_replace("value", "/", " ") if slash else F.col("value")
    return decls.withColumn("part", F.explode(F.filter(F.split(F.trim(value), r"\s+"), lambda p: p != "")))


def closest_colors(distinct: DataFrame, tokens: dict[str, str], most: float = values.COLOR_NEAR) -> DataFrame:
    """value, token for distinct(value): the token equal in normal form, else the nearest within most. Tokens are configuration: their
    Lab values stand in the plan, every colour meets them as an array in its own row, and the first of equals wins."""
    known = [(i, n, h, *color.lab(h)) for i, (n, v) in enumerate(tokens.items()) if (h := color.normalised(v))]
    if not known:
        return distinct.select("value", F.lit(None).cast("string").alias("token")).where("false")
    names = ("ord", "token", "token_hex", "t_l", "t_a", "t_b")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t, strict=True)]) for t in known])
    mine = values.once(distinct.select("value").distinct(), hex=color.normalise(F.col("value"))).where("hex is not null")
    pairs = color.with_lab(mine, "hex", "v").select("value", "hex", "v_l", "v_a", "v_b", F.inline(listed))
    near = values.once(color.with_delta_e(pairs, "v", "t", "off"), near=F.when(F.col("hex") == F.col("token_hex"), -1.0).otherwise(F.col("off"))).where(F.col("near") <= most)
    return near.groupBy("value").agg(F.min_by("token", F.struct("near", "ord")).alias("token"))


#: Tasks that the rows of one key are dealt to.
SHARES = 32


def dealt_join(many: DataFrame, key: str, few: DataFrame, own_key: str) -> DataFrame:
    """many(key, file, line, col, ...) joined to few on few's own_key. Code repeats a few keys very often: the rows of each are dealt to SHARES tasks, and
    unlike in a broadcast join of what is already shuffled, no task reads what one scan of files gave."""
    shared = few.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).hint("shuffle_hash")
    own = F.pmod(F.xxhash64("file", "line", "col"), F.lit(SHARES)).cast("int")
    return many.withColumn("own", own).join(shared, (F.col(key) == F.col(own_key)) & (F.col("own") == F.col("share")))


@rule("no-hardcoded-color")
def hardcoded_color(facts: DataFrame, config: Config) -> DataFrame:
    prop, value = F.col("name"), F.col("value")
    styled = facts_of(facts, "decl").where(prop.rlike(values.COLOR_PROP) | prop.rlike(values.VARIABLE_PROP)).unionByName(facts_of(facts, "at_rule"))
    static = F.regexp_replace(value, r"^\{?\s*[\"'`]|[\"'`]\s*\}?$", "")
    attrs = facts_of(facts, "attr", "jsx").where(prop.isin("color", "fill", "stroke", "backgroundColor", "borderColor", "stopColor", "floodColor")).where(~value.rlike(r"^\{\s*[^\"'`]")).withColumn("value", static)
    found = styled.unionByName(attrs).where(values.has_color(value) & ~values.is_token(value))
    lookup = closest_colors(found.select("value"), config.tokens.colors)
    fixed = found.join(lookup, "value", "left")
    return violation(fixed, "no-hardcoded-color", F.concat(F.lit("Hard-coded colour \""), value, F.lit("\" in "), prop), F.when(F.col("token").isNotNull(), F.concat(F.lit("var("), F.col("token"), F.lit(")"))), value)


@rule("no-arbitrary-spacing")
def arbitrary_spacing(facts: DataFrame, config: Config) -> DataFrame:
    part = F.col("part")
    parts = parts_of(facts_of(facts, "decl").where(F.col("name").rlike(values.SPACING_PROP)))
    skip = part.isin("0", "auto") | part.endswith("%") | values.is_token(part) | part.rlike(r"^(?:calc|env)\(")
    parts, px = values.once(parts, px=values.px_of(part)), F.col("px")
    bad = ~skip & F.when(px.isNotNull(), ~values.in_scale(px, config.tokens.spacing)).otherwise(part.rlike(values.UNIT))
    return violation(parts.where(bad), "no-arbitrary-spacing", F.concat(F.lit('"'), part, F.lit('" in '), F.col("name"), F.lit(" is not on the spacing scale")), old=part)


@rule("no-arbitrary-font-size")
def arbitrary_font_size(facts: DataFrame, config: Config) -> DataFrame:
    value = F.trim("value")
    sizes = facts_of(facts, "decl").where((F.col("name") == "font-size") & ~values.is_token(value))
    sizes, px = values.once(sizes, px=values.px_of(value)), F.col("px")
    bad = sizes.where(~F.coalesce(values.in_scale(px, config.tokens.font_sizes), F.lit(False)))
    near = values.nearest(px, config.tokens.font_sizes, values.FONT_NEAR)
    return violation(bad, "no-arbitrary-font-size", F.concat(F.lit('Font size "'), value, F.lit('" is not on the scale')), F.concat(values.number_text(near), F.lit("px")), value)


@rule("no-unauthorized-font-family")
def unauthorized_font_family(facts: DataFrame, config: Config) -> DataFrame:
    first = values.first_family(F.col("value"))
    allowed = [f.lower() for f in config.tokens.font_families]
    bad = facts_of(facts, "decl").where((F.col("name") == "font-family") & ~values.is_token(F.col("value")) & ~F.lower(first).isin(*allowed, ""))
    return violation(bad, "no-unauthorized-font-family", F.concat(F.lit('Font family "'), first, F.lit('" is not a token')), old=first)


@rule("no-arbitrary-radius")
def arbitrary_radius(facts: DataFrame, config: Config) -> DataFrame:
    part = F.col("part")
    parts = parts_of(facts_of(facts, "decl").where(F.col("name").rlike(values.RADIUS_PROP)), slash=True)
    skip = part.isin("0", "auto") | part.endswith("%") | values.is_token(part) | part.startswith("calc(")
    parts, px = values.once(parts, px=values.px_of(part, rem=False)), F.col("px")
    bad = ~skip & F.when(px.isNotNull(), ~values.in_scale(px, config.tokens.radii)).otherwise(part.rlike(values.UNIT))
    near = values.nearest(px, config.tokens.radii, values.RADIUS_NEAR)
    return violation(parts.where(bad), "no-arbitrary-radius", F.concat(F.lit('Radius "'), part, F.lit('" is not on the scale')), F.concat(values.number_text(near), F.lit("px")), part)


@rule("enforce-contrast")
def enforce_contrast(facts: DataFrame, config: Config) -> DataFrame:
    """Text colour against the first background that is a plain colour in the same block; inline declarations have no block. A
    block is gathered once: its first background and its text colours."""
    block = ["file", "unit", "id"]
    decls = facts_of(facts, "decl").where(F.col("id").isNotNull() & F.col("name").isin("color", "background", "background-color"))
    plain = values.once(decls, hex=color.normalise(F.col("value"))).where("hex is not null").withColumn("text", F.col("name") == "color")
    back = F.min(F.when(~F.col("text"), F.struct("seq", "hex", "value")))
    texts = F.collect_list(F.when(F.col("text"), F.struct("line", "col", "hex", "value")))  # those of one block of one file
    both = plain.groupBy(*block).agg(back.alias("back"), texts.alias("texts")).where("back is not null").select("file", F.col("back.hex").alias("back"), F.col("back.value").alias("back_value"), F.inline("texts"))
    need = 7.0 if config.wcag_level == "AAA" else 4.5
    bad = values.once(both, ratio=color.contrast(F.col("hex"), F.col("back"))).where(F.col("ratio") < need)
    return violation(bad, "enforce-contrast", F.concat(F.lit("Contrast of "), F.col("value"), F.lit(" on "), F.col("back_value"), F.lit(" is "), F.format_string("%.2f", "ratio"), F.lit(f", {need:g} is needed")), old=F.col("value"))


@rule("no-tailwind-arbitrary")
def tailwind_arbitrary(facts: DataFrame, config: Config) -> DataFrame:
    t = config.tokens
    bracketed = F.filter(values.class_names(F.col("value")), lambda c: c.contains("["))
    each = facts_of(facts, "class").where(F.col("value").contains("[")).select("file", "line", "col", F.explode(bracketed).alias("name"))
    parsed = values.once(each.select("name").distinct(), c=values.arbitrary_class(F.col("name"))).where("c is not null and c.category <> 'other'")
    number, category, raw = F.col("c.number"), F.col("c.category"), F.col("c.raw")
    listed = [v.lower() for v in t.colors.values()]
    exact = F.when(category == "color", F.lower(raw).isin(*listed) if listed else F.lit(False))
    near = F.lit(None).cast("double")
    for kind, scale, most in (("spacing", t.spacing, values.SPACING_NEAR), ("fontSize", t.font_sizes, values.FONT_NEAR), ("radius", t.radii, values.RADIUS_NEAR)):
        exact = exact.when(category == kind, values.in_scale(number, scale))
        near = F.when(category == kind, values.nearest(number, scale, most)).otherwise(near)
    bad = parsed.where(~F.coalesce(exact, F.lit(False)) & ~values.is_token(raw)).withColumn("near", near)
    colors = bad.where(category == "color").select(raw.alias("value"))
    lookup = closest_colors(colors, t.colors).withColumnRenamed("value", "raw_color")
    judged = bad.join(lookup, F.when(category == "color", raw) == F.col("raw_color"), "left")  # distinct names: code repeats few of them very often
    value = F.coalesce(F.concat(F.lit("var("), F.col("token"), F.lit(")")), F.concat(values.number_text(F.col("near")), F.lit("px")))
    said = judged.select(F.col("name").alias("said"), F.concat(F.lit('Class "'), F.col("name"), F.lit('" holds '), raw, F.lit(", which is no "), category, F.lit(" token")).alias("message"), F.concat("c.head", value, "c.tail").alias("fix"))
    return violation(dealt_join(each, "name", said, "said"), "no-tailwind-arbitrary", F.col("message"), F.col("fix"), F.col("name"))


#: Elements whose attributes rules ask for; all of these rules read one and the same gathering of attributes.
ASKED = ("img", "div", "span", "button", "input", "textarea", "select")


def with_attrs(facts: DataFrame, names: list[str]) -> DataFrame:
    """Elements of component files with the names and the entries (name, value) of their attributes, in order."""
    elements = facts_of(facts, "element", "jsx").where(F.col("name").isin(*names)).select("file", "id", "name", "line", "col")
    attrs = facts_of(facts, "attr", "jsx").where(F.col("selector").isin(*ASKED)).groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "value"))).alias("entries"))
    joined = elements.join(attrs, ["file", "id"], "left")
    return joined.withColumn("names", F.coalesce(F.transform("entries", lambda e: e["name"]), F.array().cast("array<string>")))


def attr_value(name: str) -> Column:
    return F.get(F.filter("entries", lambda e: e["name"] == name), 0)["value"]


def has_attr(*names: str) -> Column:
    return F.arrays_overlap("names", F.array(*[F.lit(n) for n in names]))


@rule("no-img-without-alt")
def img_without_alt(facts: DataFrame, config: Config) -> DataFrame:
    rows = with_attrs(facts, ["img"]).where(~has_attr("alt") | attr_value("alt").rlike(r"^\{\s*undefined\s*\}$"))
    return violation(rows, "no-img-without-alt", F.lit("Image without alt"))


@rule("no-div-button")
def div_button(facts: DataFrame, config: Config) -> DataFrame:
    role = F.coalesce(attr_value("role").rlike(r"^(?:\{\s*)?[\"'`]button[\"'`]"), F.lit(False))
    rows = with_attrs(facts, ["div", "span"]).where(has_attr("onClick")).where(~(role & has_attr("tabIndex") & has_attr("onKeyDown", "onKeyPress")))
    return violation(rows, "no-div-button", F.concat(F.lit("Clickable <"), F.col("name"), F.lit("> needs role, tabIndex and a key handler")))


@rule("no-empty-button")
def empty_button(facts: DataFrame, config: Config) -> DataFrame:
    buttons = with_attrs(facts, ["button"]).where(~has_attr("aria-label", "aria-labelledby"))
    blank = F.col("value").rlike(r"^\{\s*(?:/\*.*\*/|[\"'`]\s*[\"'`]|null|undefined|false)?\s*\}$")
    inside = facts_of(facts, "element", "jsx").unionByName(facts_of(facts, "text", "jsx").where(~blank)).select("file", F.col("parent").alias("id"))
    return violation(buttons.join(inside, ["file", "id"], "left_anti"), "no-empty-button", F.lit("Button without content or label"))


@rule("no-missing-form-label")
def missing_form_label(facts: DataFrame, config: Config) -> DataFrame:
    kind = F.lower(F.regexp_extract(attr_value("type"), r"[\"'`]([^\"'`]*)[\"'`]", 1))
    exempt = (F.col("name") == "input") & F.coalesce(kind.isin("submit", "reset", "button", "hidden", "image"), F.lit(False))
    rows = with_attrs(facts, ["input", "textarea", "select"]).where(~exempt & ~has_attr("aria-label", "aria-labelledby"))
    return violation(rows, "no-missing-form-label", F.concat(F.lit("<"), F.col("name"), F.lit("> without label")))


@rule("no-positive-tabindex")
def positive_tabindex(facts: DataFrame, config: Config) -> DataFrame:
    number = F.regexp_extract("value", r"^\{\s*\+?(\d+(?:\.\d+)?)\s*\}$", 1).try_cast("double")
    rows = facts_of(facts, "attr", "jsx").where((F.col("name") == "tabIndex") & (number > 0))
    return violation(rows, "no-positive-tabindex", F.concat(F.lit("tabIndex "), F.col("value"), F.lit(" is positive")))


@rule("no-autofocus")
def autofocus(facts: DataFrame, config: Config) -> DataFrame:
    return violation(facts_of(facts, "attr", "jsx").where("name = 'autoFocus'"), "no-autofocus", F.lit("autoFocus takes the focus on load"))


@rule("no-xss-dangerous")
def xss_dangerous(facts: DataFrame, config: Config) -> DataFrame:
    callee = F.regexp_extract("value", r"__html\s*:\s*([\w$.]+)\s*\(", 1)
    rows = facts_of(facts, "attr", "jsx").where((F.col("name") == "dangerouslySetInnerHTML") & ~callee.rlike("(?i)sanitize|purify|clean"))
    return violation(rows, "no-xss-dangerous", F.lit("Raw markup without a sanitiser"))


# Paths of code that never reaches a client, public prefixes, words of sensitive names.
SERVER_PATH = r"\.server\.|\/server\/|\/api\/|(?:^|[/.])(?:next|vite|webpack|jest|vitest)\.config\.[jt]s$|\/scripts\/"
PUBLIC_ENV = ("NEXT_PUBLIC_", "VITE_", "PUBLIC_", "REACT_APP_")


def code_matches(facts: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """One row for each match of a pattern in a line of code outside strings and comments."""
    return facts_of(facts, "code", "jsx").where(F.col("value").rlike(pattern)).withColumn("hit", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))))


@rule("no-env-in-client")
def env_in_client(facts: DataFrame, config: Config) -> DataFrame:
    rows = code_matches(facts, r"\bprocess\.env\.([A-Za-z_]\w*)").where(~F.col("file").rlike(SERVER_PATH))
    for prefix in PUBLIC_ENV:
        rows = rows.where(~F.col("hit").startswith(prefix))
    first = facts_of(facts, "directive").where("value = 'use server'").select("file")
    return violation(rows.join(first, "file", "left_anti"), "no-env-in-client", F.concat(F.lit("process.env."), F.col("hit"), F.lit(" in client code")))


# Methods that log.
LOGS = ("log", "info", "warn", "error", "debug")
#: Token kinds that open and close, in the order of each other; a chain is what may stand before the last name of a member.
OPENS, CLOSES = ("(", "[", "{", "`", "<"), (")", "]", "}", "'", ">")
CHAIN = r"(?:w|s|\(\)|\[\]|\{\}|`')(?:\.w|\(\)|\[\])*"


def bracketed(tokens: DataFrame) -> DataFrame:
    """tokens(file, seq, kind, value, line, col) with their place among brackets: mate (seq of an opening one's close), around (seq, kind and whole of
    the bracket they stand in; whole: with its close it is all of an argument), part (seq of the comma or bracket that their argument begins after),
    shut (depth of brackets that are more than grouping, templates or expressions in these), only (the name that a bracket holds alone), and
    called, at: whether and where a call of console that logs opens here."""
    order, here = Window.partitionBy("file").orderBy("seq"), (Window.unboundedPreceding, Window.currentRow)
    opens, closes = F.col("kind").isin(*OPENS), F.col("kind").isin(*CLOSES)
    back = lambda c, n: F.lag(c, n).over(order)
    called = (F.col("kind") == "(") & back("value", 1).isin(*LOGS) & (back("kind", 2) == ".") & (back("value", 3) == "console") & ~F.coalesce(back("kind", 4) == ".", F.lit(False))
    only = F.when((F.lead("kind").over(order) == "w") & (F.lead("kind", 2).over(order) == "]"), F.lead("value").over(order))
    t = tokens.select(
        "file", "seq", "kind", "value", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(*here)).alias("after"), F.coalesce(F.lead("kind").over(order).isin(*CLOSES, ","), F.lit(False)).alias("last"),
        F.coalesce(back("kind", 1).isin(*OPENS, ","), F.lit(False)).alias("first"), called.alias("called"), F.struct(back("line", 3).alias("line"), back("col", 3).alias("col")).alias("at"), only.alias("only"), back("seq", 1).alias("before"),
    )
    pairs = Window.partitionBy("file", F.when(opens, F.col("after")).when(closes, F.col("after") + 1)).orderBy("seq")
    mate, opened = F.when(opens, F.lead("seq").over(pairs)), F.lag(F.struct("first", "kind")).over(pairs)
    whole = opens & F.col("first") & F.coalesce(F.lead("last").over(pairs), F.lit(False))
    is_open = lambda kind, whole: (kind == "<") | (kind.isin("(", "`") & whole)
    step = F.when(opens & ~is_open(F.col("kind"), F.col("whole")), 1).when(closes & ~F.coalesce(is_open(F.col("opened.kind"), F.col("opened.first") & F.col("last")), F.lit(True)), -1).otherwise(0)
    t = t.withColumns({"mate": mate, "whole": whole, "opened": opened}).withColumn("step", step)
    level = Window.partitionBy("file", "after").orderBy("seq").rowsBetween(*here)
    t = t.withColumns({"inside": F.last(F.when(opens, F.struct("seq", "kind", "whole")), ignorenulls=True).over(level), "since": F.last(F.when(opens | (F.col("kind") == ","), F.col("seq")), ignorenulls=True).over(level)})
    # a bracket that opens stands where the token before it does, or in it
    around, part = F.when(opens, back("inside", 1)).otherwise(F.col("inside")), F.when(opens, back("since", 1)).otherwise(F.col("since"))
    return t.withColumns({"around": around, "part": part, "shut": F.sum("step").over(order.rowsBetween(*here))})


def logged_names(tokens: DataFrame) -> DataFrame:
    """file, line, col, seq of every call of console that logs, and the name of each argument that has one: a name, the last name of a member, a key
    of an object, or one of these in a template or brackets. Other expressions have none."""
    t = bracketed(tokens)
    calls = t.where("called and mate is not null").select("file", F.col("seq").alias("call"), F.col("mate").alias("end"), F.col("shut").alias("base"), "at.line", "at.col")
    around = F.col("shut") - F.when(F.col("step") > 0, 1).otherwise(0)  # of the bracket a token stands in
    key = (F.col("around.kind") == "{") & F.col("around.whole")
    role = F.explode(F.when(key, F.array(F.struct(around.alias("base"), F.lit(False).alias("key")), F.struct((around - 1).alias("base"), F.lit(True).alias("key")))).otherwise(F.array(F.struct(around.alias("base"), F.lit(False).alias("key")))))
    pieces = t.where("kind <> ',' and part is not null").select("file", "seq", "kind", "value", "only", "part", role.alias("r")).select("file", "seq", "kind", "value", "only", "part", "r.key", "r.base")
    found = pieces.join(calls, ["file", "base"]).where("seq > call and seq < end")
    parts = found.groupBy("file", "call", "line", "col", "key", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "value", "only"))).alias("p"))
    shape = F.array_join(F.transform("p", lambda x: x["kind"]), "")
    first, last, text = F.get("p", 0), F.element_at("p", -1), lambda x: F.regexp_replace(x["value"], "^[\"']|[\"']$", "")
    of_argument = F.when(F.col("shape").rlike(rf"^(?:w|{CHAIN}\.w)$"), last["value"]).when(F.col("shape").rlike(rf"^{CHAIN}\[\]$"), F.get("p", F.size("p") - 2)["only"])
    of_key = F.when(F.col("shape").rlike(r"^(?:w$|[ws]:|w\(\)\{\}$)"), text(first)).when(F.col("shape").rlike(r"^ww\(\)\{\}$"), F.get("p", 1)["value"]).when(F.col("shape").rlike(r"^\[\]:"), first["only"])
    named = parts.withColumn("shape", shape).withColumn("name", F.when(F.col("key"), of_key).otherwise(of_argument)).where("name is not null")
    return named.select("file", "line", "col", "call", first["seq"].alias("seq"), "name")


@rule("no-console-sensitive")
def console_sensitive(facts: DataFrame, config: Config) -> DataFrame:
    """Tokens follow from a text alone, so equal texts, which their facts name, are looked at once."""
    found = facts_of(facts, "tokens", "jsx").select("file", "line", "col", F.coalesce("value", F.concat(F.lit("file "), F.col("file"))).alias("text"), "structure")
    each = found.groupBy(F.col("text").alias("file")).agg(F.first("structure").alias("structure")).select("file", F.posexplode("structure").alias("seq", "token"))
    parts = F.split("token", " ", 3)
    tokens = each.select("file", "seq", F.substring("token", 1, 1).alias("kind"), parts[2].alias("value"), F.substring(parts[0], 2, 9).cast("int").alias("line"), parts[1].cast("int").alias("col"))
    said = logged_names(tokens).where(F.col("name").rlike(values.SENSITIVE))
    first = said.groupBy("file", "line", "col", "call").agg(F.min_by("name", "seq").alias("word"))
    calls = first.groupBy(F.col("file").alias("of")).agg(F.collect_list(F.struct("line", "col", "word")).alias("calls"))  # those of one text
    placed = dealt_join(found.select("file", "line", "col", "text"), "text", calls, "of").select("file", F.inline("calls"))
    return violation(placed, "no-console-sensitive", F.concat(F.lit('"'), F.col("word"), F.lit('" is logged')))


CREDENTIAL = r"(?i)\b(?:password|passwd|secret|api_?key|auth_?token|access_?token|private_?key|token)[\"']?\s*[:=]\s*[\"'`]([^\"'`\s]{8,})[\"'`]"


@rule("no-hardcoded-credentials")
def hardcoded_credentials(facts: DataFrame, config: Config) -> DataFrame:
    """A rule of our own: a name that speaks of a credential is given a literal of eight characters or more."""
    rows = facts_of(facts, "source").withColumn("hit", F.explode(F.regexp_extract_all("value", F.lit(CREDENTIAL), F.lit(1))))
    return violation(rows, "no-hardcoded-credentials", F.lit("Credential in the source"))


# What opens a task and what counts as its ticket.
TODO, TICKET = r"(?i)\b(?:TODO|FIXME)\b", r"(?:#\d+|[A-Z][A-Z0-9_]*-\d+|\[[A-Z][A-Z0-9_]*-\d+\]|https?:\/\/)"


@rule("no-todo-without-ticket")
def todo_without_ticket(facts: DataFrame, config: Config) -> DataFrame:
    rows = facts_of(facts, "comment").where(F.col("value").rlike(TODO) & ~F.col("value").rlike(TICKET))
    return violation(rows, "no-todo-without-ticket", F.concat(F.lit("Open task without ticket: "), F.substring("value", 1, 80)))


@rule("no-magic-numbers")
def magic_numbers(facts: DataFrame, config: Config) -> DataFrame:
    text = F.regexp_replace("value", "_", "")
    number = F.when(text.rlike("^0[xX]"), F.conv(F.substring(text, 3, 20), 16, 10)).otherwise(text).try_cast("double")
    rows = facts_of(facts, "number").where(~F.coalesce(number.isin(0.0, 1.0, 2.0), F.lit(False)))
    return violation(rows, "no-magic-numbers", F.concat(F.lit("Unnamed number "), F.col("value")))


@rule("no-oversized-component")
def oversized_component(facts: DataFrame, config: Config) -> DataFrame:
    lines = F.col("end_line") - F.col("id") + 1
    rows = facts_of(facts, "component").where((F.col("value") == "block") & (lines > 300))
    return violation(rows, "no-oversized-component", F.concat(F.lit("Component "), F.col("name"), F.lit(" has "), lines.cast("string"), F.lit(" lines")))


@rule("no-console-log")
def console_log(facts: DataFrame, config: Config) -> DataFrame:
    excused = facts_of(facts, "comment", "jsx").where(F.col("value").rlike("eslint-disable")).select("file", "line").distinct()
    rows = code_matches(facts, r"\bconsole\.log\s*(\()").join(excused, ["file", "line"], "left_anti")
    return violation(rows, "no-console-log", F.lit("console.log left in"))


@rule("no-inline-styles")
def inline_styles(facts: DataFrame, config: Config) -> DataFrame:
    names = F.regexp_extract_all("value", F.lit(r"(?:[{,]\s*)[\"']?([A-Za-z_$][\w$-]*)[\"']?\s*:"), F.lit(1))
    rows = facts_of(facts, "attr", "jsx").where((F.col("name") == "style") & F.col("value").rlike(r"^\{\s*\{")).withColumn("names", names).where(F.size("names") > 0)
    return violation(rows, "no-inline-styles", F.concat(F.lit("Inline style: "), F.array_join("names", ", ")))


def parse_errors(facts: DataFrame) -> DataFrame:
    return violation(facts_of(facts, "error"), "parse-error", F.concat(F.lit("Cannot parse: "), F.col("value")))


def severity_of(name: str, config: Config) -> str | None:
    """The configured severity of a rule; None if it is off."""
    own = config.rules.get(name)
    return None if own == "off" else "warning" if own == "warn" else own or DEFAULTS.get(name, "warning")


def apply(facts: DataFrame, config: Config, rules: dict[str, Rule] | None = None) -> DataFrame:
    """All violations of the per-file rules that are on; only those appear in the plan."""
    found = [parse_errors(facts)]
    for name, check in (RULES if rules is None else rules).items():
        if (severity := severity_of(name, config)) is not None:
            found.append(check(facts, config).withColumn("severity", F.lit(severity)))
    return reduce(DataFrame.unionByName, [f.select(*COLUMNS) for f in found])
