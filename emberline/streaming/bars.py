"""Candles and phases over streams of ticks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.series import KEYS
from ..functions.shared import shared_path
from ..operators.amd import AMD_INPUTS, AMD_OUTPUTS, automaton


def stream_bars(ticks: DataFrame, every: str, price: str, ts: str = "ts", tie: Sequence[str] = (), keys: Sequence[str] = ("instrument",), late: str = "1 hour", timeframe: str | None = None, slide: str | None = None) -> DataFrame:
    """The bars of a stream of ticks, final once the watermark has passed their end; ticks later than `late` are left out.

    slide: a bar of length `every` begins that often, so bars overlap. On a table that does not stream it gives all bars.
    """
    ticks = ticks.withColumn("_at", F.col(ts).cast("timestamp"))
    order = F.struct("_at", *tie)
    p = F.col(price)
    out = ticks.withWatermark("_at", late).groupBy(*keys, F.window("_at", every, slide).alias("_w"))
    out = out.agg(F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count("*").alias("volume"))
    return out.select(*keys, F.lit(timeframe or every).alias("timeframe"), F.col("_w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, gap: str, price: str, ts: str = "ts", tie: Sequence[str] = (), keys: Sequence[str] = ("instrument",), late: str = "1 hour") -> DataFrame:
    """Runs of ticks at most `gap` apart: their start, their end (the last tick plus the gap), prices and ticks. A run is final once the watermark has passed its end."""
    ticks = ticks.withColumn("_at", F.col(ts).cast("timestamp"))
    order = F.struct("_at", *tie)
    p = F.col(price)
    out = ticks.withWatermark("_at", late).groupBy(*keys, F.session_window("_at", gap).alias("_w"))
    out = out.agg(F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count("*").alias("volume"))
    return out.select(*keys, F.col("_w.start").alias("timestamp"), F.col("_w.end").alias("ends"), "open", "high", "low", "close", "volume")


def count_late(spark: SparkSession, ticks: DataFrame, every: str, name: str, ts: str = "ts", keys: Sequence[str] = ("instrument",), late: str = "1 hour") -> DataFrame:
    """Runs over what a stream of ticks has now and returns, by batch, series and bar, the ticks that came when their bar was final: those that stream_bars leaves out.

    A batch's bars are final by the greatest time of the batches before it, less `late`; what comes in the next batch for one of them is late. Each batch writes its counts and its greatest time under its own number, so one that is
    tried again writes the same.
    """
    path = shared_path(spark, name)
    seconds = f"CAST(INTERVAL {late} AS INTERVAL SECOND)"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("_at", F.col(ts).cast("timestamp"))
        before = session.read.schema("latest timestamp, batch long").parquet(f"{path}/times").where(F.col("batch") < number - 1).agg(F.max("latest")).first()[0] if number > 1 else None
        final = F.lit(False) if before is None else F.window("_at", every)["end"] <= F.lit(before) - F.expr(seconds)
        counts = rows.where(final).groupBy(*keys, F.window("_at", every)["start"].alias("timestamp")).agg(F.count("*").alias("n_late"))
        counts.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows.agg(F.max("_at").alias("latest")).write.mode("overwrite").parquet(f"{path}/times/batch={number}")

    query = ticks.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kinds = dict(ticks.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "timestamp timestamp", "n_late long", "batch long"])
    return spark.read.schema(schema).parquet(f"{path}/late")


def stream_as_of(low: DataFrame, high: DataFrame, columns: Sequence[str], seconds: int, on: Sequence[str] = ("instrument",), late: str = "1 hour", prefix: str = "htf_") -> DataFrame:
    """A stream of lower bars with the columns of the higher bar, `seconds` long, that closed last: between its close and that of the next one.

    Two watermarks and the interval between the streams' times bound what is kept of each. A lower bar whose higher bar is missing has no row; where no higher bar is missing
    the rows are those of setups.as_of.
    """
    names = {c: f"{prefix}{c}" for c in columns}
    known = high.select(*(F.col(c).alias(f"_{c}") for c in on), F.timestamp_seconds(F.unix_timestamp("timestamp") + seconds).alias("_known"), *(F.col(c).alias(n) for c, n in names.items()))
    known = known.withWatermark("_known", late)
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    during = (F.col("timestamp") >= F.col("_known")) & (F.col("timestamp") < F.col("_known") + F.expr(f"INTERVAL {seconds} SECONDS"))
    for c in same:
        during &= c
    return low.withWatermark("timestamp", late).join(known, during).drop("_known", *(f"_{c}" for c in on))


def stream_phases(features: DataFrame, keys: Sequence[str] = KEYS, **options: object) -> DataFrame:
    """The phase automaton over a stream of bars with features: the batch operator's step, with its thirteen numbers kept as state between batches.

    Bars of a series must come in order of time from batch to batch; within one they are sorted.
    """
    kinds = dict(features.dtypes)
    names = [n for n, _ in AMD_OUTPUTS]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "timestamp timestamp", *(f"{n} {t.simpleString()}" for n, t in AMD_OUTPUTS)])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        step = automaton(**options, state=kept)
        bars = pd.concat(frames).sort_values("timestamp")
        rows = [[None if pd.isna(v) else v for v in r] for r in bars[list(AMD_INPUTS)].itertuples(index=False)]
        out = pd.DataFrame([step(*r) for r in rows], columns=names)
        out.insert(0, "timestamp", bars["timestamp"].to_numpy())
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        state.update((json.dumps(kept),))
        yield out

    columns = features.select(*keys, "timestamp", *AMD_INPUTS)
    return columns.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now, with a Parquet sink in the shared folder, and returns the table it wrote."""
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
