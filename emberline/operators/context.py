"""Sessions, calendar and market regime: row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import column_or, flag


def add_session_classifier(df: DataFrame) -> DataFrame:
    """session by UTC hour: 0 Asian [0, 8), 1 London [8, 13), 3 overlap [13, 17), 2 New York [17, 22), 4 none; hours since its start."""
    hour = F.hour("timestamp")
    session = F.when(hour < 8, 0).when(hour < 13, 1).when(hour < 17, 3).when(hour < 22, 2).otherwise(4)
    start = F.when(hour < 8, 0).when(hour < 13, 8).when(hour < 17, 13).when(hour < 22, 17).otherwise(22)
    return df.withColumns({"session": session, "london_open": flag((hour >= 8) & (hour < 10)), "ny_open": flag((hour >= 13) & (hour < 15)), "is_dead_zone": flag(hour >= 22), "hours_since_session": F.pmod(hour - start, F.lit(24)).cast("double")})


def add_time_features(df: DataFrame) -> DataFrame:
    day = F.weekday("timestamp")
    return df.withColumns({"day_of_week": day, "is_friday": flag(day == 4), "hour_of_day": F.hour("timestamp")})


def add_regime(df: DataFrame) -> DataFrame:
    """0 ranging, 2 trending, else 1. Columns that are absent count as missing or 0."""
    none, zero = F.lit(None).cast("double"), F.lit(0)
    adx, slope = column_or(df, "adx_14", none), column_or(df, "ema_20_slope", none)
    narrow = column_or(df, "bb_width_below_40", zero) == 1
    steps = (column_or(df, "hh_count", zero) >= 2) | (column_or(df, "ll_count", zero) >= 2)
    regime = F.when((adx < 20) & narrow, 0).when((adx > 25) & steps & (F.abs(slope) > 0.1), 2).otherwise(1)
    label = F.when(F.col("regime") == 0, "RANGING").when(F.col("regime") == 2, "TRENDING").otherwise("TRANSITIONAL")
    return df.withColumn("regime", regime).withColumn("regime_label", label)
