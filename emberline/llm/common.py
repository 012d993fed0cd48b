"""Helpers that the operators of this folder share: written tables, Arrow batches, chunks of text, gapless ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.shared import shared_path

CHUNK = 1 << 20
"""Characters that a numpy step takes at a time; a longer text makes a chunk of its own."""


SLICE = 4 << 20
"""Bytes of an Arrow batch that a worker takes at a time."""


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and a lost executor costs no recomputation of it.

    Hashes do not compress, and the codec's buffers for pages of long arrays live outside the heap: such tables are better left plain ("none").
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about limit bytes, so that a worker's memory doesn't depend on how many rows Spark puts in a batch."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, n * limit // max(batch.nbytes, 1))
        for i in range(0, max(n, 1), step):
            yield batch.slice(i, step)


def append_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], Sequence[pa.Array]], fields: Sequence[T.StructField]) -> DataFrame:
    """df with the columns fn makes of each Arrow batch; an input column of the same name is replaced."""
    new = {f.name for f in fields}
    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in new]
    schema = T.StructType([df.schema.fields[i] for i in keep] + list(fields))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(fn(batch)), names=names)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def chunks(texts: Sequence, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with about limit characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def document_id(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string"))


def hash60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a column as text; null is taken as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def gapless_rank(df: DataFrame, group: Sequence[str], spread: str, order: Sequence[str], weight: str, per_task: int = 10_000) -> DataFrame:
    """df with `first`: the sum of weight over the rows before it in its group, in the order of spread and then order.

    There should be a bounded number of groups: their sums are broadcast. spread is a column of numbers in [0, 2^60), evenly spread over the rows
    (so not a hash of something that many rows share). A group is cut into ranges of it by its own size, so no task gets much
    more than per_task of the weight at once even if a group holds all rows; the ranges' sums say where each begins.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.sum(weight) / per_task).alias("_ranges"))
    df = df.join(F.broadcast(sizes), group).withColumn("_range", F.floor(F.col(spread) / F.ceil(F.lit(1 << 60) / F.col("_ranges"))).cast("int")).drop("_ranges")
    begins = df.groupBy(*group, "_range").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.withColumn("_begin", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_range").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return df.join(begins, [*group, "_range"]).withColumn("first", (F.col("_begin") + F.col("_within")).cast("long")).drop("_range", "_begin", "_within")


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over uint64: each bit of the input moves all bits of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
