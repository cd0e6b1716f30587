"""Language identification by prediction by partial matching.

One byte context tree for each language holds, up to ORDER preceding bytes, how often each byte followed; contexts that the
language used fewer than LEAST_USES times are pruned. A byte costs -log2 P, where P is taken from the longest context that the language's tree holds:
c / (T + D) if the byte was seen there (T: uses, D: different bytes), else the escape D / (T + D) times the P of the next shorter context, down
to 1/257 (method C, no exclusions). The statistics are frozen after training, so every (context, byte) has one code length for each language,
rounded to 1/UNIT bit; tasks add them over all bytes of a text. The language with the shortest code wins. Trees are stored in groups of TOGETHER
languages that share a table; which languages share one changes no code length, and there may be any number of languages.

Training reads SAMPLE whole texts of each language at most (the first ids by a hash; of rows that share an id and a language the smallest text), of rows in the training folds. What the driver
gathers are the distinct byte windows of these texts.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the smaller language value; with no
training rows everything is `und`; ids may repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import doc_crc32, materialize, row_slices, text_buffers

ORDER = 3
#: Texts of each language that training may use.
SAMPLE = 300
#: A language keeps a context if it used it at least so often.
LEAST_USES = 2
#: Languages that share a table.
TOGETHER = 8
SLICE = 1 << 20
#: Code lengths are whole multiples of 1/256 bit.
UNIT = 256
UNDETERMINED = "und"


def count_grams(order: int):
    """A mapInArrow function (lang, text) -> (lang, gram, n): counts of windows of order + 1 bytes; before the text
    starts the window holds the mark 256, so a window is a number in base 257."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                b = np.r_[np.full(order, 256), raw[offsets[i] : offsets[i + 1]].astype(np.int64)]
                code = np.zeros(max(0, len(b) - order), np.int64)
                for k in range(order + 1):
                    code = code * 257 + b[k : len(b) - order + k]
                grams, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    return run


def build_models(rows: list[tuple[str, int, int]], order: int = ORDER) -> list[dict]:
    """Frozen code lengths from (lang, gram, n) counts of windows of order + 1 bytes, TOGETHER languages in each model."""
    langs = sorted({r[0] for r in rows})
    groups = [set(langs[k : k + TOGETHER]) for k in range(0, len(langs), TOGETHER)]
    return [build_model([r for r in rows if r[0] in group], order) for group in groups]


def build_model(rows: list[tuple[str, int, int]], order: int = ORDER) -> dict:
    langs = sorted({r[0] for r in rows})
    grams = np.array([r[1] for r in rows], np.int64)
    n = np.array([r[2] for r in rows], np.int64)
    which = np.array([langs.index(r[0]) for r in rows], np.int64)
    window = np.stack([grams // 257**k % 257 for k in range(order, -1, -1)], axis=1)
    seen = np.unique(window)
    size = len(seen) + 1  # one class for each byte met in training (and the mark), one for all others
    classes = np.searchsorted(seen, window)
    contexts = []
    for k in range(order + 1):
        code = np.zeros(len(rows), np.int64)
        for j in range(order - k, order):
            code = code * size + classes[:, j]
        ids, back = np.unique(code, return_inverse=True)
        uses = np.zeros((len(langs), len(ids)), np.int64)
        np.add.at(uses, (which, back), n)
        contexts.append((ids[uses.max(axis=0) >= (LEAST_USES if k else 0)], code))
    nodes = sum(len(ids) for ids, _ in contexts)
    symbol = classes[:, -1]
    base, first = [], 0
    for ids, _ in contexts:
        base.append(first)
        first += len(ids)
    table = np.zeros((nodes, size, len(langs)))
    for l in range(len(langs)):
        mine = which == l
        for k, (ids, code) in enumerate(contexts):
            counts = np.zeros((len(ids), size))
            at = np.searchsorted(ids, code[mine])
            at = np.minimum(at, len(ids) - 1) if len(ids) else at
            kept = (ids[at] == code[mine]) if len(ids) else np.zeros(0, bool)
            np.add.at(counts, (at[kept], symbol[mine][kept]), n[mine][kept])
            total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            if k == 0:
                lower = np.full((len(ids), size), 1 / 257)
            else:
                short = ids % size ** (k - 1)
                lower = table[_node(contexts, base, k - 1, short, size), :, l]
            held = total >= LEAST_USES if k else total > 0  # by this language
            with np.errstate(divide="ignore", invalid="ignore"):
                table[base[k] : base[k] + len(ids), :, l] = np.where(~held, lower, np.where(counts > 0, counts / (total + kinds), kinds / (total + kinds) * lower))
    bits = np.minimum(np.round(-np.log2(table) * UNIT), 65535).astype(np.uint16)
    links = []
    # links[k - 1]: from (byte k back, state of the k - 1 nearer bytes) to the deepest kept context; a state is a context.
    codes, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of each state: its context's code and order
    for k in range(1, order + 1):
        longer = np.arange(size)[:, None] * np.where(depth == k - 1, size ** (k - 1), 0)[None, :] + codes[None, :]
        ids = contexts[k][0]
        at = np.minimum(np.searchsorted(ids, longer), max(0, len(ids) - 1))
        good = (depth == k - 1)[None, :] & (len(ids) > 0)
        good = good & (ids[at] == longer) if len(ids) else np.zeros_like(longer, bool)
        good = np.broadcast_to(good, longer.shape)
        states = len(codes)
        new_codes, new_depth = np.r_[codes, ids], np.r_[depth, np.full(len(ids), k)]
        links.append(np.where(good, states + at, np.arange(states)[None, :]).astype(np.int32).ravel())
        codes, depth = new_codes, new_depth
    node = np.zeros(len(codes), np.int64)
    for k in range(order + 1):
        at = depth == k
        node[at] = base[k] + np.searchsorted(contexts[k][0], codes[at])
    to_class = np.full(257, size - 1, np.int64)
    to_class[seen] = np.arange(len(seen))
    return {"langs": langs, "order": order, "size": size, "to_class": to_class, "links": links, "node": node.astype(np.int64), "bits": bits.reshape(nodes * size, len(langs))}


def _node(contexts, base, k: int, code: np.ndarray, size: int) -> np.ndarray:
    """Row in the table of each context code of order k, or of its longest kept suffix."""
    ids = contexts[k][0]
    at = np.minimum(np.searchsorted(ids, code), max(0, len(ids) - 1))
    good = ids[at] == code if len(ids) else np.zeros(len(code), bool)
    out = base[k] + at
    if not good.all():
        out = np.where(good, out, _node(contexts, base, k - 1, code % size ** (k - 1), size))
    return out


def code_lengths(model: dict, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length of every text in every language, in 1/UNIT bits."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(model["langs"])), np.int64)
    size, order = model["size"], model["order"]
    mark = model["to_class"][256]
    for lo, hi in row_slices(offsets, SLICE):
        at = offsets[lo : hi + 1] - offsets[lo]
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        sym = model["to_class"][raw[offsets[lo] : offsets[hi]]]
        state, states = np.zeros(len(sym), np.int64), 1
        for k in range(1, order + 1):
            prev = np.empty_like(sym)
            prev[k:] = sym[:-k] if k < len(sym) else sym[:0]
            prev[:k] = mark
            for j in range(k):
                early = at[:-1][full] + j
                prev[early[early < at[1:][full]]] = mark
            link = model["links"][k - 1]
            state = link[prev * (len(link) // size) + state]
        cost = model["bits"][model["node"][state] * size + sym]
        out[lo + full] = np.add.reduceat(cost, at[:-1][full], axis=0, dtype=np.int64)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> list[dict]:
    """Count byte windows of the sampled training texts and freeze the trees. Training rows: lang not null and
    crc32(doc_id) mod 5 not 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("lang is not null").where(doc_crc32(F.col("doc_id")) % 5 != 0).distinct()
    per = rows.groupBy("lang").count()
    # A hash threshold leaves about twice the sample of each language, so that ranking it is small work.
    near = rows.join(per, "lang").withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).where(F.col("order") < F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.lit(2.0 * sample + 50) / F.col("count")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))).where(F.col("rank") <= sample)
    picked = materialize(ranked.select(F.col("doc_id").alias("picked_id"), F.col("lang").alias("picked_lang")), "ppm-sample")  # sample rows of each language
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(picked, F.col("doc_id").eqNullSafe(F.col("picked_id")) & (F.col("lang") == F.col("picked_lang")), "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    grams = texts.select("lang", "text").mapInArrow(count_grams(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build_models(sorted(tuple(r) for r in grams.collect()), order)


def classifier(models):
    """A mapInArrow function (doc_id, text, letters) -> (doc_id, lang_pred, score); models is a broadcast list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [lang for m in models.value for lang in m["langs"]]
        for batch in batches:
            known = np.array(batch.column("letters").to_pylist(), bool) if batch.num_rows else np.zeros(0, bool)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if names and batch.num_rows:
                raw, offsets = text_buffers(batch.column("text"))
                bits = np.hstack([code_lengths(m, raw, offsets) for m in models.value])
                best = bits.argmin(axis=1)
                gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) / UNIT, 1000)
                score = 1 / np.exp2(-gap).sum(axis=1)
            pred = [names[b] if k and names else UNDETERMINED for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.where(known & bool(names), score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, order))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    scored = plain.mapInArrow(classifier(models), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (doc_crc32(F.col("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score")
