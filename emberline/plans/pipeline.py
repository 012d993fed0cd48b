"""The full indicator stack over a candle table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.scan import dealt, scan
from ..functions.series import KEYS, ordered, with_bar_index
from ..operators.amd import amd_state_pass
from ..operators.levels import volume_profile_pass, vp_distance
from ..operators.zones import equal_hl_candidates, equal_hl_pass, fvg_candidates, fvg_fill_pass, fvg_pass, ifvg_pass, ob_mitigation_pass

DAY = 86400
INTRADAY_COLUMNS = ("asian_high", "asian_low", "asian_range", "asian_range_ratio", "session", "london_open", "ny_open", "is_dead_zone", "hours_since_session", "day_of_week", "is_friday", "hour_of_day")


def build_all_indicators(df: DataFrame, instrument: str | None = None, swing_window: int = 3, swing_mode: str = "symmetric_causal", include_vp: bool = True, include_avwap: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with all layers' columns. Series whose bars are a day or more apart, by the median, get NULL in INTRADAY_COLUMNS, and so do those of one bar.

    What needs prices only comes first, while rows are narrow; the sequential operators - smoothers and ranks, then zones and phases - run in one
    pass each. swing_mode: symmetric, symmetric_causal, or causal, which takes a window of 6 in place of 3; any other is symmetric.
    """
    df = df.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")})
    df = with_bar_index(dealt(df, keys), keys)
    df = op.add_asian_session_hl(op.add_prev_week_hl(op.add_prev_day_hl(df, keys), keys), keys)
    df = op.add_time_features(op.add_session_classifier(df))
    df = df.withColumn("_step", F.unix_timestamp("timestamp") - F.lag(F.unix_timestamp("timestamp")).over(ordered(keys)))
    df = df.withColumn("_step", F.median("_step").over(Window.partitionBy(*keys)))
    df = df.withColumns({c: F.when(F.col("_step") < DAY, F.col(c)) for c in INTRADAY_COLUMNS}).drop("_step")
    df = op.add_candle_delta_proxy(op.add_key_volume_flags(op.add_volume_ratio(df, keys=keys), keys=keys), keys)
    df = op.add_wick_ratio(op.add_vsa(df, keys))
    df = op.add_foundation(df, keys, atr_rank="_atr_rank")
    if swing_mode == "causal":
        df = op.add_swings_causal(df, 6 if swing_window == 3 else swing_window, keys=keys)
    else:
        df = op.add_swings(df, swing_window, causal=swing_mode == "symmetric_causal", keys=keys)
    df = op.add_choch(op.add_bos(op.add_trend_state(df, keys), keys), keys)
    df = op.add_rolling_atr_ratio(op.add_rsi_divergence(df, keys=keys), keys=keys)
    df = op.add_liquidity_sweep(op.add_displacement_candle(df, keys=keys), keys=keys)
    df = op.add_amd_features(df, atr_rank="_atr_rank", keys=keys)
    df = op.add_ob(df, keys=keys)
    df = equal_hl_candidates(fvg_candidates(df, keys=keys), keys=keys)
    passes = [fvg_pass(), fvg_fill_pass(), ifvg_pass(), ob_mitigation_pass(), equal_hl_pass(), amd_state_pass(), *([volume_profile_pass()] if include_vp else [])]
    df = scan(df, passes, keys).drop("_next_bull", "_next_bear", "_price_high", "_price_low")
    df = op.add_round_number_flag(df, instrument, keys)
    if include_vp:
        df = df.withColumn("vp_poc_distance_atr", vp_distance())
    if include_avwap:
        df = op.add_avwap_from_last_swing(df, keys)
    return op.add_regime(df)
