"""The numbered queries of this folder over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, decontam, langid, neardup, packing, pii, preference, repair, repetition, search, sharding, sketch, warc
from .common import document_id
from .oracle import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.format_pairs(preference.with_corrupted(preference.conversations(_table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    digests = [F.col("pair_id"), F.col("n_common"), F.col("prompt")]
    for side in ("chosen", "rejected"):
        digests += [F.col(f"{side}_completion"), F.array_join(F.col(f"{side}_mask").cast("array<string>"), "").alias(f"{side}_mask"), spans(f"{side}_spans").alias(f"{side}_spans")]
    return rows.select(*digests)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(document_id(), F.lit(3)) == 1
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = repair.repair(repair.damaged(turns)).withColumnRenamed("conv_id", "conv")
    whole = turns.select("conv_id").distinct().join(rows, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.array().cast("array<struct<role:string,text:string>>")
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), repair.digest(F.coalesce("repaired", none)).alias("repaired_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.neighbours(_table(spark, sf_dir, "documents"))
    digests = [F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch.encoded(F.col("sketch")).alias("fingerprint"), sketch.encoded(F.col("edited_sketch")).alias("edited_fingerprint")]
    return rows.select("doc_id", *digests, "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_preference_formatting, op2_language_id, op3_warc_index, op4_decontamination, op5_personal_data, op6_near_duplicates,
        op7_jump_shards, op8_class_lm, op9_best_fit_packing, op10_repetition, op11_conversation_repair,
        op12_ranked_search, op13_fingerprints, pipeline,
    )
}
