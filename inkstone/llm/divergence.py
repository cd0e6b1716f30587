"""Quality rules by distribution divergence.

Each language's reference holds the shares of character classes and of common words over all documents of that lang value (null
is a value of its own). A document is compared with its language's reference by the Jensen-Shannon distance (base 2, 0 to 1) of both
histograms. A common word makes up at least 1 / RARE of its language's words, so a language has RARE of them at most; all other words
are one bin. Short documents scatter by chance: the word divergence may exceed its limit by the expected divergence of a sample of
that length, (bins - 1) / (8 ln 2 words), and documents under the length guards are not judged.

Base measures and the base rule are those of base_measures. Defined cases: null texts have no words; words are what stands between
white space, other columns are ignored; repeated rows are each judged; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import SPACE_RUN, let, materialize, words

RARE = 512
MIN_WORDS, MIN_CHARS = 50, 200
#: Limits of the distances.
CHAR_LIMIT, WORD_LIMIT = 0.27, 0.45
CLASSES = ("upper", "lower", "letter", "number", "punct", "space", "other")
SYMBOLS = "#*$%&|<>"


def _repeat_words(ws: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""

    def covered(sorted_: Column) -> Column:
        same = F.filter(sorted_, lambda x, j: (F.get(sorted_, j - 1)["g"] == x["g"]) | (F.get(sorted_, j + 1)["g"] == x["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))

    def count(windows: Column) -> Column:
        placed = F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(placed), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.array_join(F.slice(ws, i, 3), " "))
    return F.when(F.size(ws) >= 4, let(windows, count)).otherwise(F.lit(0)).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the counts of CLASSES.

    base_failed: fewer than 50 words, or over half of the words in repeated windows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64("lang", "text").alias("text_key"))
    # Classes are taken out one after the other, the largest first, so that only the first pass reads the whole text.
    rest, stripped = "text", []
    for name, pattern in (("lower", r"\p{Ll}+"), ("space", SPACE_RUN), ("upper", r"\p{Lu}+"), ("letter", r"\p{L}+"), ("punct", r"\p{P}+"), ("number", r"\p{N}+")):
        plain = plain.withColumn(f"no_{name}", F.regexp_replace(rest, pattern, ""))
        stripped.append((F.length(rest) - F.length(f"no_{name}")).cast("long").alias(name))
        rest = f"no_{name}"
    split = plain.withColumn("w", words(F.col("text")))
    lined = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = split.select(
        "doc_id", "lang", "text_key",
        F.size("w").cast("long").alias("n_words"),
        (F.length("no_space") - F.length(F.translate("no_space", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lined, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        let(F.col("w"), _repeat_words).alias("n_repeat_words"),
        *stripped, F.length(rest).cast("long").alias("other"), F.length("text").cast("long").alias("chars"),
    )
    classed = out.withColumn("word_chars", F.col("chars") - F.col("space"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return classed.withColumn("base_failed", failed)


def _half(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence of p and q."""
    side = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return (side(p) + side(q)) / 2


def _root(divergence: Column) -> Column:
    return F.when(divergence.isNotNull(), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def class_references(measures: DataFrame) -> DataFrame:
    """lang and the share of every character class over all of its documents."""
    sums = measures.groupBy("lang").agg(*[F.sum(c).alias(c) for c in (*CLASSES, "chars")])
    return sums.select(F.col("lang").alias("ref_lang"), *[(F.col(c) / F.col("chars")).alias(f"ref_{c}") for c in CLASSES])


def word_references(docs: DataFrame) -> DataFrame:
    """ref_lang, word, share of every common word, over all words of all documents of the language."""
    each = docs.select(F.col("lang").cast("string").alias("lang"), F.explode(words(F.col("text"))).alias("word"))
    counted = materialize(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "rules-words")
    totals = counted.groupBy(F.col("lang").alias("total_lang")).agg(F.sum("n").alias("total"))
    shared = counted.join(totals, F.col("lang").eqNullSafe(F.col("total_lang"))).where(F.col("n") * RARE >= F.col("total"))
    return shared.select(F.col("lang").alias("ref_lang"), "word", (F.col("n") / F.col("total")).alias("share"))


def word_divergences(docs: DataFrame, measures: DataFrame, references: DataFrame) -> DataFrame:
    """doc_key, text_key, hits: for each document, sums over the common words that it uses."""
    each = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_key"), F.xxhash64("lang", "text").alias("text_key"), F.coalesce(F.col("lang").cast("string"), F.lit("\x00")).alias("lang"), F.explode(words(F.col("text"))).alias("word"))
    known = references.select(F.coalesce("ref_lang", F.lit("\x00")).alias("lang"), "word", "share")
    return each.join(known, ["lang", "word"]).groupBy("doc_key", "text_key", "word").agg(F.count(F.lit(1)).alias("hits"), F.first("share").alias("share"))


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, the base measures, base_failed, char_distance, word_distance and kept for every row of docs."""
    measures = materialize(base_measures(docs), "rules-base")
    references = materialize(word_references(docs), "rules-common")
    held = references.groupBy("ref_lang").agg(F.sum("share").alias("common_share"), F.count(F.lit(1)).alias("bins"))
    per_lang = class_references(measures).join(held.withColumnRenamed("ref_lang", "held_lang"), F.col("ref_lang").eqNullSafe(F.col("held_lang")), "left").drop("held_lang")
    copies = measures.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_key"), "text_key").agg(F.sum("n_words").alias("all_words"))
    hits = word_divergences(docs, measures, references).join(copies, ["doc_key", "text_key"])
    p = F.col("hits") / F.col("all_words")
    used = hits.groupBy("doc_key", "text_key").agg(F.sum(p).alias("p_used"), F.sum("share").alias("q_used"), F.sum(_half(p, F.col("share"))).alias("js_used"))
    rows = measures.withColumn("doc_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).join(used, ["doc_key", "text_key"], "left")
    rows = rows.join(per_lang, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    char_js = sum((_half(F.col(c) / F.col("chars"), F.col(f"ref_{c}")) for c in CLASSES[1:]), _half(F.col(CLASSES[0]) / F.col("chars"), F.col(f"ref_{CLASSES[0]}")))
    rest = _half(F.greatest(F.lit(0.0), 1 - zero("p_used")), F.greatest(F.lit(0.0), 1 - zero("common_share")))
    word_js = zero("js_used") + (zero("common_share") - zero("q_used")) / 2 + rest
    chance = F.coalesce(F.col("bins"), F.lit(0)) / (8 * math.log(2) * F.col("n_words"))
    judged = rows.withColumn("char_js", F.when(F.col("chars") > 0, char_js)).withColumn("word_js", F.when(F.col("n_words") > 0, word_js))
    char_far = (F.col("word_chars") >= min_chars) & (_root(F.col("char_js")) > char_limit)
    word_far = (F.col("n_words") >= min_words) & (_root(F.col("word_js") - chance) > word_limit)
    far = F.coalesce(char_far, F.lit(False)) | F.coalesce(word_far, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round(_root(F.col("char_js")), 6).alias("char_distance"), F.round(_root(F.col("word_js")), 6).alias("word_distance"), (~F.col("base_failed") & ~far).alias("kept"),
    )
