"""Quotation linking: from quoted passages in messages to the messages they come from, and to reply-ordered conversations.

A line's quote level is the number of `>` marks it starts with. A passage is a run of lines of one level above 0. Passages are
normalised (lower case, white space as one space), hashed and linked to the earliest message of the same conversation that has one as a unit (its own text
as a whole, a paragraph, a line), if that is earlier than the quoting message; otherwise to the earliest one before it whose own text holds the passage's words in sequence, so
that a quote trimmed to any part of a line or of several lines is found. For that, runs of 1, 2, 4, ... words are hashed, each from two of half its length: a
passage stands where the longest such run that fits it stands at its start and another at its end, and each pair of message and passage that is found is
compared once, word for word. A message replies to the original of its linked passages of the
lowest level, the latest of these. Links stay inside a conversation. Threads
follow replies to their roots by pointer doubling; a conversation in reply order lists threads by their root's turn and each
thread by turn, so every reply stands after what it answers. Own text is what is left without passages and the
attribution lines right before them; paragraphs and lines of it also end where a passage stood.

Defined cases: null texts are empty; a null turn comes first and is nobody's original; messages equal in conversation and turn are separate rows that share
their reply's target (the earliest found); a null conv_id is one conversation; repeated rows are kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import let, materialize, with_position

MARKS = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)(wrote|writes|said|écrit|schrieb|escribió)[ \t]*:[ \t]*$"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, row_key, own (text without quotes), units (normalised own units) and passages (level, text)."""
    plain = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = plain.withColumn("row_key", F.xxhash64("role", "text"))
    marked = F.transform(F.split("text", "\r?\n"), lambda l: F.struct(F.length(F.regexp_replace(F.regexp_extract(l, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(l, MARKS, "").alias("body")))
    lined = plain.select("conv_id", "turn", "role", "row_key", marked.alias("lines"))

    def passages(ls: Column) -> Column:
        starts = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x["level"].alias("level"), ((i == 0) | (F.get(ls, i - 1)["level"] != x["level"])).alias("first"))), lambda s: s["first"])
        runs = let(starts, lambda st: F.transform(st, lambda s, k: F.struct(s["level"].alias("level"), F.slice(ls, s["i"] + 1, F.coalesce(F.get(st, k + 1)["i"], F.size(ls)) - s["i"]).alias("part"))))
        quoted = F.filter(runs, lambda r: r["level"] > 0)
        return F.filter(F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), normalise(F.array_join(F.transform(r["part"], lambda p: p["body"]), "\n")).alias("text"))), lambda q: q["text"] != "")

    def kept(ls: Column, x: Column, i: Column) -> Column:
        return (x["level"] == 0) & ~(F.coalesce(F.get(ls, i + 1)["level"] > 0, F.lit(False)) & x["body"].rlike(ATTRIBUTION))

    def own(ls: Column) -> Column:
        left = F.filter(ls, lambda x, i: kept(ls, x, i))
        return F.regexp_replace(F.array_join(F.transform(left, lambda x: x["body"]), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")

    def broken(ls: Column) -> Column:
        """The own text with an empty line for every line that is not in it."""
        return F.array_join(F.transform(ls, lambda x, i: F.when(kept(ls, x, i), x["body"]).otherwise(F.lit(""))), "\n")

    parsed = lined.select("conv_id", "turn", "role", "row_key", let(F.col("lines"), own).alias("own"), let(F.col("lines"), broken).alias("broken"), let(F.col("lines"), passages).alias("passages"))
    pieces = F.concat(F.array(F.col("own")), F.split("broken", r"\n[\x20\x09-\x0D]*\n"), F.split("broken", "\n"))
    units = F.filter(F.array_distinct(F.transform(pieces, normalise)), lambda u: u != "")
    return parsed.withColumn("units", units).drop("broken")


def _with_runs(df: DataFrame, text: str, levels: int) -> DataFrame:
    """df with words, the number n of them, and run0, run1, ...: hashes of all runs of 1, 2, 4, ... words of a normalised text, by place."""
    out = df.withColumn("ws", F.split(text, " ")).withColumn("n", F.size("ws")).withColumn("run0", F.transform("ws", lambda w: F.xxhash64(w)))
    for k in range(1, levels):
        half, before = 1 << (k - 1), F.col(f"run{k - 1}")
        starts = F.when(F.col("n") >= 2 * half, F.sequence(F.lit(0), F.greatest(F.col("n") - 2 * half, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"run{k}", _joined(starts, before, half))
    return out


def _joined(starts: Column, before: Column, half: int) -> Column:
    return F.transform(starts, lambda i: F.xxhash64(F.get(before, i), F.get(before, i + half)))


def _inside(parsed: DataFrame, quoted: DataFrame, conv: Column) -> DataFrame:
    """conv, hash, turn of messages whose own words hold a passage of quoted(conv, hash, text) in sequence."""
    passages = materialize(quoted.select("conv", "hash", "text").distinct(), "quote-wanted")
    longest = passages.agg(F.max(F.size(F.split("text", " ")))).first()[0] or 1
    levels = longest.bit_length()
    level = sum(F.when(F.col("n") >= 1 << k, 1).otherwise(0) for k in range(1, levels)) + F.lit(0)
    ends = _with_runs(passages, "text", levels).withColumn("level", level)

    def run_at(place: Column) -> Column:
        return F.coalesce(*[F.when(F.col("level") == k, F.get(f"run{k}", place)) for k in range(levels)])

    gap = F.col("n") - F.coalesce(*[F.when(F.col("level") == k, F.lit(1 << k)) for k in range(levels)])
    wanted = materialize(ends.select("conv", "hash", "n", "level", gap.alias("gap"), run_at(F.lit(0)).alias("head"), run_at(gap).alias("tail")), "quote-ends")
    said = parsed.where("turn is not null").select(conv, "turn", normalise(F.col("own")).alias("said")).join(wanted.select("conv").distinct(), "conv", "left_semi")
    said = materialize(said.groupBy("conv", "said").agg(F.min("turn").alias("turn")).withColumn("said_key", F.md5("said")), "quote-said")  # of equal texts only the first counts
    runs = F.concat(*[F.transform(f"run{k}", _place(k)) for k in range(levels)])
    places = _with_runs(said, "said", levels).select("conv", "said_key", F.explode(runs).alias("r")).select("conv", "said_key", "r.*")
    looked_for = wanted.select("conv", "level", F.explode(F.array("head", "tail")).alias("run")).distinct()
    places = materialize(places.join(looked_for, ["conv", "level", "run"], "left_semi"), "quote-places")
    starts = places.join(wanted, (places["conv"] == wanted["conv"]) & (places["level"] == wanted["level"]) & (places["run"] == wanted["head"]))
    starts = starts.select(places["conv"], "said_key", places["level"], "hash", "n", "at", (F.col("at") + F.col("gap")).alias("end_at"), F.col("tail").alias("run"))
    both = starts.join(places.withColumnRenamed("at", "end_at"), ["conv", "said_key", "level", "end_at", "run"], "left_semi")
    found = materialize(both.groupBy("conv", "said_key", "hash", "n").agg(F.min("at").alias("at")), "quote-found")
    held = found.join(said, ["conv", "said_key"]).join(passages, ["conv", "hash"])
    return held.where(F.array_join(F.slice(F.split("said", " "), F.col("at") + 1, F.col("n")), " ") == F.col("text")).select("conv", "hash", "turn")


def _place(level: int):
    return lambda run, at: F.struct(F.lit(level).alias("level"), at.alias("at"), run.alias("run"))


def link(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, row_key, level, hash, original (turn or null) of every quoted passage."""
    conv = F.coalesce("conv_id", F.lit(-(1 << 63)).cast("long")).alias("conv")
    quoted = materialize(parsed.select(conv, "turn", "row_key", F.posexplode("passages").alias("place", "p")).select("conv", "turn", "row_key", "place", "p.level", "p.text", F.md5("p.text").alias("hash")), "quote-passages")
    units = parsed.where("turn is not null").select(conv, "turn", F.explode("units").alias("u")).select("conv", F.md5("u").alias("hash"), "turn")
    holders = units.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    first = materialize(holders.groupBy("conv", "hash").agg(F.min("turn").alias("unit_of")), "quote-units")
    by_unit = quoted.join(first, ["conv", "hash"], "left").withColumn("unit_of", F.when(F.col("unit_of") < F.col("turn"), F.col("unit_of")))
    by_unit = materialize(by_unit, "quote-by-unit")
    inside = _inside(parsed, by_unit.where("unit_of is null and turn is not null"), conv)
    part = materialize(inside.groupBy("conv", "hash").agg(F.min("turn").alias("part_of")), "quote-parts")
    found = by_unit.join(part, ["conv", "hash"], "left")
    original = F.coalesce("unit_of", F.when(F.col("part_of") < F.col("turn"), F.col("part_of")))
    return found.select("conv", "turn", "row_key", "place", "level", "hash", original.alias("original"))


def threads(parents: DataFrame) -> DataFrame:
    """conv, turn, root, depth for parents(conv, turn, parent), by pointer doubling: each round doubles how far everyone has followed."""
    now = materialize(parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "thread")
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = now.join(up, (now["conv"] == up["c"]) & (now["root"] == up["t"]), "left")
        new = materialize(moved.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moving")), "thread")
        if new.where("moving").isEmpty():
            return new.drop("moving")
        now = new.drop("moving")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, n_passages, n_linked, parent_turn, thread_turn, depth and position (0, 1, ... in the
    conversation's reply order) of every message of messages(conv_id, turn, role, text)."""
    parsed = parse(messages)
    links = materialize(link(parsed), "quote-links")
    lowest = F.min(F.when(F.col("original").isNotNull(), F.struct(F.col("level"), (-F.col("original")).alias("late"))))
    replies = materialize(links.where("turn is not null").groupBy("conv", "turn").agg((-lowest["late"]).alias("parent")).where("parent is not null"), "quote-replies")
    counts = links.groupBy("conv", F.coalesce("turn", F.lit(-(1 << 63)).cast("long")).alias("at"), "row_key").agg(F.count(F.lit(1)).alias("all_passages"), F.count("original").alias("all_linked"), F.count_if(F.col("place") == 0).alias("copies"))
    tops = threads(replies)
    rows = parsed.select("conv_id", F.coalesce("conv_id", F.lit(-(1 << 63)).cast("long")).alias("conv"), "turn", F.coalesce("turn", F.lit(-(1 << 63)).cast("long")).alias("at"), "role", "row_key", "own")
    rows = rows.join(counts, ["conv", "at", "row_key"], "left").join(replies, ["conv", "turn"], "left").join(tops, ["conv", "turn"], "left")
    placed = rows.select(
        "conv", "conv_id", "turn", "role", "row_key", F.col("own").alias("own_text"),
        F.coalesce(F.col("all_passages") / F.col("copies"), F.lit(0)).cast("long").alias("n_passages"), F.coalesce(F.col("all_linked") / F.col("copies"), F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    numbered = materialize(with_position(placed, ["conv", "thread_turn", "turn", "row_key"], "seq", "quote-order"), "quote-ordered")
    firsts = materialize(numbered.groupBy("conv").agg(F.min("seq").alias("first")), "quote-firsts")  # written, so that the join of a long conversation can be split
    return numbered.join(firsts, "conv").select("conv_id", "turn", "role", "own_text", "n_passages", "n_linked", "parent_turn", "thread_turn", "depth", (F.col("seq") - F.col("first")).alias("position"))
