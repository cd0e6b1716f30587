"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import blob_ledger, containment, cube_mix, divergence, filter_audit, html_layout, periodic_runs, pii, ppm_language, quotes, simhash_gph, subword_quality, token_rans
from inkstone.llm.common import with_position
from inkstone.llm.oracle import ORACLE


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(_read(spark, sf_dir, "pages"))


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(_read(spark, sf_dir, "conversations"))


def op2_quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where messages quote: each is given a part of the one before, its whole text, or that at the second level."""
    told = with_position(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], "seq", "replies")
    before = told.select(F.col("conv_id").alias("of"), (F.col("seq") + 1).alias("after"), F.col("text").alias("before"))
    told = told.join(before, told["conv_id"].eqNullSafe(before["of"]) & (told["seq"] == before["after"]), "left")
    part = F.array_join(F.slice(F.split(F.regexp_replace("before", "\n", " "), " "), 3, 10), " ")
    text = (
        F.when(F.col("before").isNull(), F.col("text"))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("> "), part, F.lit("\n"), "text"))
        .when(F.col("turn") % 3 == 2, F.concat(F.lit("One wrote:\n> "), F.regexp_replace("before", "\n", "\n> "), F.lit("\n"), "text"))
        .otherwise(F.concat(F.lit(">> "), F.regexp_replace("before", "\n", "\n>> "), F.lit("\n"), "text", F.lit("\n> no such words were ever said")))
    )
    return quotes.conversations(told.select("conv_id", "turn", "role", text.alias("text")))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(_read(spark, sf_dir, "documents"))


def op4_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rans.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(_read(spark, sf_dir, "documents"))


def op7_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gph.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identify(_read(spark, sf_dir, "documents"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_read(spark, sf_dir, "documents")))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_repeats(_read(spark, sf_dir, "documents"))))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are imported into a new ledger, a doc_id being a path."""
    versions = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("path"), "text")
    ledger = blob_ledger.new_ledger(spark)
    held, _ = blob_ledger.import_versions(versions, ledger)
    return blob_ledger.digest(blob_ledger.findings(held, ledger))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_layout, op2_quote_linking, op2_quoted_replies, op3_divergence_rules, op4_token_rans, op5_containment_search, op6_cube_mix, op7_simhash_gph, op8_ppm_language, op9_pii_spans, op10_subword_quality, op11_periodic_runs, op12_blob_ledger, op13_filter_audit)
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
