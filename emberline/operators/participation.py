"""Volume and candle shape: volume ratio and slope, delta proxy, volume spread analysis, wicks, displacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import KEYS, flag, mean, ordered, ratio
from .foundation import ensure_atr
from .structure import wicks


def add_volume_ratio(df: DataFrame, period: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Volume over its average, and the least squares slope of the last five volumes over that average."""
    volume = F.col("volume").cast("double")
    df = df.withColumn("_avg", mean(volume, period, keys)).withColumn("vol_ratio", ratio(volume, F.col("_avg")))
    lag = lambda n: F.lag(volume, n).over(ordered(keys))
    slope = (2 * volume + lag(1) - lag(3) - 2 * lag(4)) / 10
    return df.withColumns({"vol_above_1_5x": flag(F.col("vol_ratio") > 1.5), "vol_below_0_8x": flag(F.col("vol_ratio") < 0.8), "vol_slope_5": ratio(slope, F.col("_avg"))}).drop("_avg")


def add_key_volume_flags(df: DataFrame, period: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    volume = F.col("volume").cast("double")
    average = mean(volume, period, keys)
    return df.withColumns({"vol_above_avg": flag(volume > average), "vol_below_avg": flag(volume < average)})


def add_candle_delta_proxy(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where in the bar's range it closed, times the volume ratio; 0 without range."""
    volume = F.col("volume").cast("double")
    times = F.col("vol_ratio") if "vol_ratio" in df.columns else ratio(volume, mean(volume, 20, keys))
    spread = F.col("high") - F.col("low")
    return df.withColumn("candle_delta_proxy", F.when(spread > 0, (F.col("close") - F.col("low")) / spread * times).otherwise(0.0))


def add_vsa(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """High volume in a small range (absorption), high volume in a large one (directional)."""
    volume, spread = F.col("volume").cast("double"), F.col("high") - F.col("low")
    busy, usual = volume > mean(volume, 20, keys), mean(spread, 20, keys)
    return df.withColumns({"vsa_absorption": flag(busy & (spread < usual * 0.7)), "vsa_directional": flag(busy & (spread > usual * 1.3))})


def add_wick_ratio(df: DataFrame) -> DataFrame:
    upper, lower, _ = wicks()
    return df.withColumns({"upper_wick_ratio": upper, "lower_wick_ratio": lower})


def add_displacement_candle(
    df: DataFrame, body_atr_mult: float = 1.5, *, close_extreme_frac: float = 0.20, min_body_frac: float = 0.60, max_opposite_wick_frac: float = 0.20, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Bars with a large body that close near their extreme with little wick against it."""
    df = ensure_atr(df, keys=keys)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    upper, lower, body = wicks()
    spread = h - low
    direction = F.when(c > o, 1).when(c < o, -1).otherwise(0)
    body_atr = F.when(F.col("atr_14") > 0, F.abs(c - o) / F.col("atr_14")).otherwise(0.0)
    near = F.coalesce(F.when(spread > 0, F.when(c > o, h - c).when(c < o, c - low) / spread) <= close_extreme_frac, F.lit(False))
    against = F.when(c > o, lower).when(c < o, upper).otherwise(0.0)
    df = df.withColumns({"displacement_direction": direction, "displacement_body_atr": body_atr, "displacement_close_extreme": flag(near)})
    found = (F.col("displacement_direction") != 0) & (F.col("displacement_body_atr") >= body_atr_mult) & near & (body >= min_body_frac) & (against <= max_opposite_wick_frac)
    df = df.withColumn("displacement_candle", flag(found))
    on = F.col("displacement_candle") == 1
    return df.withColumns({"displacement_bull_candle": flag(on & (F.col("displacement_direction") == 1)), "displacement_bear_candle": flag(on & (F.col("displacement_direction") == -1))})
