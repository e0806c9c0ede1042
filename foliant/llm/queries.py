"""The registered queries of this subpackage: each applies an operator to its whole tables and derives the columns of its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, extraction, hard_negatives, jaccard, language, lexical, mixing, oracles, outliers, pii, quality, token_files, toxicity, warc
from .quality import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    _, index = warc.archive(pages)
    rows = warc.read_back(pages, index)
    return rows.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias(
        "refers_to"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontamination.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","),
        256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(_read(spark, sf_dir, "documents"), ["doc_id"])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), names=False)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found_spans(_read(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    field = toxicity.toxicity_model(docs, _read(spark, sf_dir, "labels"))
    rows = toxicity.toxicity_scores(docs, field, ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.quality_model(docs, _read(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(_read(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    models = language.train(docs.where(~held_out("doc_id")))
    return language.predictions(docs, models, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = _read(spark, sf_dir, "documents")
    files = token_files.write_ids(docs, path("word_bpe_49k.json"), end=1)
    return token_files.read_ids(files, docs.schema["doc_id"].dataType).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "ids_ok")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_mixing that SQL can express: the targets that the flow is to meet."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_pii that SQL can express: counts and places of the base entities."""
    return op5_pii(spark, sf_dir).drop("spans", "n_spans")


def outlier_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_outliers that SQL can express: the base statistics."""
    return op3_outliers(spark, sf_dir).drop("kept", "distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_decontamination, op3_outliers, op4_mixing, op5_pii, op6_toxicity, op7_quality, op8_jaccard,
        op9_extraction, op10_language, op11_negatives, op12_search, op13_tokens, mixing_targets, pii_base, outlier_statistics)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": oracles.WARC, "op2_decontamination": oracles.DECONTAMINATION, "op8_jaccard": oracles.JACCARD, "op11_negatives": oracles.NEGATIVES, "op12_search": oracles.SEARCH,
        "mixing_targets": oracles.TARGETS, "pii_base": oracles.PERSONAL, "outlier_statistics": oracles.STATISTICS}
