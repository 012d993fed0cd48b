"""A training corpus out of documents: language ID, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; any further columns of theirs pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontam, langid, neardup, packing, pii
from emberline.llm.common import document_id, written
from emberline.llm.queries import tokenizer_path

LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose likeliest language has a posterior under one half; lang is the prediction.

    A null text has no letter. Repeated rows and ids are judged alike; a null id or lang is no reason to reject.
    """
    model = langid.fit(docs.where(F.coalesce(F.pmod(document_id(), F.lit(3)) != 1, F.lit(True))))
    rows = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return rows.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles with a similarity of 0.8 or more, the row with the smallest doc_id stays, once.

    Rows without words are in no group and stay; of repeated rows one stays; a null doc_id stays only where its group has no other.
    """
    return neardup.one_of_each(docs, n=5, percent=80, matches=(11, 76))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts. Null and empty texts stay as they are, and rows are changed one by one, repeated or not."""
    rows = decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind. Null and empty texts stay as they are; repeated rows are changed alike."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs the documents; one row per piece. Null texts are empty and give one token; repeated rows give pieces of their own."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
