"""Frames over candle series.

A table holds many series; `keys` name the columns that tell them apart and `timestamp` orders each. Missing values are NULL, never
NaN, and a flag is 1 or 0: a condition on a missing value is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("instrument", "timeframe")
ORDER = "timestamp"
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def ordered(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ORDER)


def rows(lo: int, hi: int, keys: Sequence[str] = KEYS) -> WindowSpec:
    return ordered(keys).rowsBetween(lo, hi)


def so_far(keys: Sequence[str] = KEYS) -> WindowSpec:
    return rows(FIRST, 0, keys)


def with_bar_index(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with bar_idx, the bar's number in its series from 0."""
    return df if "bar_idx" in df.columns else df.withColumn("bar_idx", F.row_number().over(ordered(keys)) - 1)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def full(aggregate: Column, of: Column, n: int, lo: int, hi: int, keys: Sequence[str] = KEYS) -> Column:
    """aggregate over rows lo to hi, NULL unless all n of them have a value."""
    frame = rows(lo, hi, keys)
    return F.when(F.count(of).over(frame) == n, aggregate.over(frame))


def mean(of: Column, n: int, keys: Sequence[str] = KEYS) -> Column:
    """Simple moving average over n bars."""
    return full(F.avg(of), of, n, -(n - 1), 0, keys)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL if b is 0 or missing."""
    return F.try_divide(a, b)


def streak(condition: Column, df: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with `name`, the number of bars up to this one on which the condition has held without a break."""
    held = F.coalesce(condition, F.lit(False))
    last_break = F.max(F.when(~held, F.col("bar_idx"))).over(so_far(keys))
    return df.withColumn(name, F.when(held, F.col("bar_idx") - F.coalesce(last_break, F.lit(-1))).otherwise(0).cast("int"))


def require(df: DataFrame, *columns: str, error: type[Exception] = ValueError) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise error(f"missing required columns: {missing}")


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
