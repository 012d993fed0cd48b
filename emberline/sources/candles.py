"""Reading, building and writing candle tables.

A candle table is Parquet partitioned by instrument and timeframe: equality on either prunes folders, a time range is pushed into the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.series import KEYS

if TYPE_CHECKING:
    from py4j.java_gateway import JavaObject, JVMView

PRICES = ("open", "high", "low", "close")
# The names of timeframes in landing files.
TIMEFRAMES = {"1d": "D", "4h": "H4", "1h": "H1", "15m": "M15"}
INSTRUMENTS = ("XAU_USD", "USOIL", "EUR_USD", "USD_JPY")


def bars(ticks: DataFrame, every: str, price: str, ts: str = "ts", tie: Sequence[str] = (), keys: Sequence[str] = ("instrument",), volume: Column | None = None) -> DataFrame:
    """Open, high, low, close and volume (ticks, or the sum of volume) of each series and bar, from ticks in the order of (ts, *tie).

    every is minute, hour, day or week, or a number of hours as in '4 hours'. Ticks are pre-aggregated before the shuffle, so a busy series
    costs no more than its bars.
    """
    count, _, unit = every.rpartition(" ")
    at = F.col(ts).cast("timestamp")
    if count:
        seconds = int(count) * {"minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
        start = F.timestamp_seconds(F.floor(F.unix_timestamp(at) / seconds) * seconds)
    else:
        start = F.date_trunc(unit, at)
    order = F.struct(at.alias("at"), *tie)
    p = F.col(price)
    agg = [F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), (F.sum(volume) if volume is not None else F.count("*")).cast("long").alias("volume")]
    name = TIMEFRAMES.get({"day": "1d", "hour": "1h", "4 hours": "4h", "15 minutes": "15m"}.get(every, ""), every)
    return ticks.groupBy(*keys, start.alias("timestamp")).agg(*agg).withColumn("timeframe", F.lit(name)).select(*keys, "timeframe", "timestamp", *PRICES, "volume")


def normalise(raw: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", arrival: str | None = None) -> DataFrame:
    """Fetched bars: time parsed as timestamp, one row per bar - the first by `arrival`, else by its values - in each series' order."""
    raw = raw.withColumn("timestamp", F.to_timestamp(time)) if time != "timestamp" else raw.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    raw = raw.drop(time) if time != "timestamp" else raw
    first = Window.partitionBy(*keys, "timestamp").orderBy(*([arrival] if arrival else [c for c in raw.columns if c not in (*keys, "timestamp")]))
    return raw.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").sortWithinPartitions(*keys, "timestamp")


def read_landing(spark: SparkSession, path: str, instruments: Sequence[str] = INSTRUMENTS, timeframes: dict[str, str] = TIMEFRAMES) -> DataFrame:
    """Landing files <INSTRUMENT>_<TF>.parquet as candles. Files of other names are left out, rows without volume dropped."""
    codes = list(timeframes.values())
    # A file of that name, or a folder of it that Spark wrote.
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.parquet(?:/part-[^/]*)?$", 1)
    pattern = f"^({'|'.join(instruments)})_({'|'.join(codes)})$"
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).withColumns({"instrument": F.regexp_extract(name, pattern, 1), "timeframe": F.regexp_extract(name, pattern, 2)})
    rows = rows.where(F.col("instrument") != "")
    volume = "tickVolume" if "tickVolume" in rows.columns else "volume"
    spread = F.col("spread").cast("int") if "spread" in rows.columns else F.lit(None).cast("int")
    return rows.select("instrument", "timeframe", F.col("timestamp").cast("timestamp").alias("timestamp"), *PRICES, F.col(volume).cast("long").alias("volume"), spread.alias("spread")).na.drop(subset=["volume"])


def write_candles(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per series; rows are dealt by series and sorted, so a folder gets few files and row groups have narrow time ranges."""
    df.repartition(*KEYS).sortWithinPartitions(*KEYS, "timestamp").write.mode(mode).partitionBy(*KEYS).parquet(path)


def append_candles(df: DataFrame, path: str) -> None:
    """Appends the bars that the table does not have yet: repeating a load changes nothing."""
    old = df.sparkSession.read.parquet(path).select(*KEYS, "timestamp")
    write_candles(df.join(old, [*KEYS, "timestamp"], "left_anti"), path)


def load_candles(spark: SparkSession, path: str, instrument: str | None = None, timeframe: str | None = None, since: datetime | str | None = None, until: datetime | str | None = None) -> DataFrame:
    """Candles of a series and time range, prices as double. Order is the windows' concern, so none is imposed."""
    df = spark.read.parquet(path)
    for name, value in (("instrument", instrument), ("timeframe", timeframe)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if since is not None:
        df = df.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return df.withColumns({c: F.col(c).cast("double") for c in PRICES})


def write_landing(df: DataFrame, path: str) -> None:
    """Each series as <INSTRUMENT>_<TF>.parquet, as read_landing takes them."""
    for r in df.select(*KEYS).distinct().collect():
        part = df.where((F.col("instrument") == r.instrument) & (F.col("timeframe") == r.timeframe)).drop(*KEYS)
        part.withColumnRenamed("volume", "tickVolume").sortWithinPartitions("timestamp").write.mode("overwrite").parquet(f"{path}/{r.instrument}_{r.timeframe}.parquet")


def save_bucketed(df: DataFrame, table: str, buckets: int = 64, keys: Sequence[str] = KEYS) -> None:
    """A table of the catalog bucketed and sorted by series, one file a bucket: windows, joins and aggregates by series over it need no exchange."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, "timestamp").saveAsTable(table)


def write_jdbc(df: DataFrame, url: str, table: str = "candles", **properties: str) -> None:
    """Appends to a database, whatever it has; see load_jdbc."""
    df.write.option("batchsize", 1000).jdbc(url, table, mode="append", properties=properties)


def load_jdbc(df: DataFrame, url: str, table: str = "candles", key: Sequence[str] = (*KEYS, "timestamp"), **properties: str) -> int:
    """Appends those rows whose key the database's table does not have, and returns how many they were.

    Rows go into a staging table of this load first, where a task that is tried again may leave rows twice; one statement in a transaction of its own then takes a row for
    each key that is missing. So a load that breaks off leaves the table as it was, and one that is repeated adds nothing. Of rows of df that share a key, the least by value
    is taken column by column. The table is made if it is not there.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    staging = f"{table}_load_{uuid.uuid4().hex[:12]}"
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    quoted = {c: dialect.quoteIdentifier(c) for c in df.columns}
    values = [c for c in df.columns if c not in key]
    # One row a key already here, so that columns of one row stay together; what is left to the statement are exact copies.
    df = df.groupBy(*key).agg(F.min(F.struct(*values)).alias("_v")).select(*key, "_v.*").select(*df.columns)
    df.limit(0).write.jdbc(url, table, mode="append", properties=properties)
    try:
        df.write.option("batchsize", 1000).jdbc(url, staging, mode="overwrite", properties=properties)
        connection = jvm.java.sql.DriverManager.getConnection(url, _properties(jvm, properties))
        try:
            connection.setAutoCommit(False)
            same = " AND ".join(f"c.{quoted[k]} = s.{quoted[k]}" for k in key)
            taken = ", ".join(f"s.{quoted[c]}" if c in key else f"MIN(s.{quoted[c]})" for c in df.columns)
            sql = f"INSERT INTO {table} ({', '.join(quoted.values())}) SELECT {taken} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} c WHERE {same}) GROUP BY {', '.join(f's.{quoted[k]}' for k in key)}"  # noqa: S608
            added = connection.createStatement().executeUpdate(sql)
            connection.commit()
            return added
        finally:
            connection.rollback()
            connection.close()
    finally:
        _execute(spark, url, f"DROP TABLE {staging}", properties)


def _properties(jvm: JVMView, properties: dict[str, str]) -> JavaObject:
    out = jvm.java.util.Properties()
    for k, v in properties.items():
        out.setProperty(k, v)
    return out


def _execute(spark: SparkSession, url: str, sql: str, properties: dict[str, str]) -> None:
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, _properties(spark._jvm, properties))
    try:
        connection.createStatement().execute(sql)
    finally:
        connection.close()


def read_jdbc(spark: SparkSession, url: str, instrument: str, timeframe: str, table: str = "candles", parts: int = 8, **properties: str) -> DataFrame:
    """A series from a database, read by several tasks: each takes a part of the time between the series' first and last bar. All conditions are pushed down."""
    mine = (F.col("instrument") == instrument) & (F.col("timeframe") == timeframe)
    first, last = spark.read.jdbc(url, table, properties=properties).where(mine).agg(F.min("timestamp"), F.max("timestamp")).first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if first is not None and first < last:
        reader = reader.options(partitionColumn="timestamp", lowerBound=str(first), upperBound=str(last), numPartitions=parts)
    return reader.load().where(mine).select("timestamp", *(F.col(c).cast("double").alias(c) for c in PRICES), "volume", "spread")
