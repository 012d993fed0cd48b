"""Sharding by jump consistent hashing: a key and the number of shards give the shard, without a table of shards.

Appending a shard moves 1 / (shards + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless_rank, hash60


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last place its jumps reach below shards (Lamping and Veach)."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.uint64).copy()
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        share = float(1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[moving] = ((at[moving] + 1) * share).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a column of longs."""

    @F.pandas_udf(T.IntegerType())
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key)


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", per_task: int = 10_000) -> DataFrame:
    """One row per row of docs: key, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 (null text: 0), law, shard, slot
    and grown_shard (with one shard more).

    Slots of a shard run from 0 without gaps, in the order of a hash of key, size and checksum. Rows that are equal in all of those
    are one row with a count, in parts of at most per_task, until they get their slots: many copies weigh little, and no array of theirs is
    longer than a part. A null key is hashed as the text 'null'; an empty table gives no rows, and other columns are left out.
    """
    rows = docs.select(F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"))
    rows = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / per_task))).alias("part"))
    rows = rows.withColumn("copies", F.least(F.lit(per_task).cast("long"), F.col("n") - F.col("part") * per_task)).drop("n").withColumn("hash", hash60(F.col("key")))
    rows = rows.withColumn("shard", shard_of(F.col("hash"), shards)).withColumn("grown_shard", shard_of(F.col("hash"), shards + 1))
    rows = rows.withColumn("spread", hash60(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), "size", "text_crc32", "part")))
    rows = gapless_rank(rows, ["shard"], "spread", ["key", "size", "text_crc32", "part"], "copies", per_task)
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
    return rows.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
