"""What each operator reads and makes, and how far its columns look ahead and back: what a live feed may use, and what can be cut into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import DataFrame

from .. import operators as op
from ..functions.chunks import SIZE, in_chunks
from ..functions.series import KEYS

WHOLE_SERIES = 10**9
"""Look-ahead of columns that depend on the whole series."""


@dataclass(frozen=True)
class Entry:
    operator: Callable[..., DataFrame]
    needs: tuple[str, ...]
    """Columns besides prices, volume and the ATR, which an operator adds if it isn't there."""
    makes: tuple[str, ...]
    """Columns, or the beginnings of their names."""
    look_ahead: int
    """Bars after its own that a column depends on, with default arguments."""
    look_back: int | None = None
    """Bars before its own likewise, the columns it needs and the ATR given; None if there is no bound."""


CATALOG: dict[str, Entry] = {
    "atr": Entry(op.add_atr, (), ("atr_14", "atr_pct_50"), 0),
    "emas": Entry(op.add_emas, (), ("ema_", "price_above_ema_"), 0),
    "adx": Entry(op.add_adx, (), ("adx_",), 0),
    "rsi": Entry(op.add_rsi, (), ("rsi_14", "rsi_above_", "rsi_below_", "rsi_delta_"), 0),
    "macd": Entry(op.add_macd, (), ("macd_hist",), 0),
    "bb_width": Entry(op.add_bb_width, (), ("bb_width",), 0, 69),
    "body_ratio": Entry(op.add_body_ratio, (), ("body_ratio",), 0, 0),
    "rolling_atr_ratio": Entry(op.add_rolling_atr_ratio, (), ("atr_ratio_rolling",), 0, 10),
    "volume_ratio": Entry(op.add_volume_ratio, (), ("vol_ratio", "vol_above_1_5x", "vol_below_0_8x", "vol_slope_5"), 0, 20),
    "key_volume_flags": Entry(op.add_key_volume_flags, (), ("vol_above_avg", "vol_below_avg"), 0, 20),
    "candle_delta_proxy": Entry(op.add_candle_delta_proxy, (), ("candle_delta_proxy",), 0, 20),
    "vsa": Entry(op.add_vsa, (), ("vsa_",), 0, 20),
    "wick_ratio": Entry(op.add_wick_ratio, (), ("upper_wick_ratio", "lower_wick_ratio"), 0, 0),
    "displacement_candle": Entry(op.add_displacement_candle, (), ("displacement_",), 0, 0),
    "swings": Entry(op.add_swings, (), ("swing_high", "swing_low"), 3),
    "last_swings": Entry(op.add_swings, (), ("last_swing_", "swing_high_age", "swing_low_age", "swing_high_confirmed", "swing_low_confirmed"), 0),
    "trend_state": Entry(op.add_trend_state, ("swing_high_price", "swing_low_price"), ("trend_state", "hh_count", "ll_count"), 3),
    "bos": Entry(op.add_bos, ("last_swing_high", "last_swing_low"), ("bos_",), 0),
    "choch": Entry(op.add_choch, ("trend_state", "bos_bull", "bos_bear"), ("choch_",), 2),
    "rsi_divergence": Entry(op.add_rsi_divergence, ("swing_high_price", "swing_low_price"), ("rsi_div_",), 3),
    "fvg": Entry(op.add_fvg, (), ("fvg_bull", "fvg_bear", "fvg_size_atr", "fvg_confirm_delay", "fvg_mid_body_atr", "fvg_bos_"), 3),
    "fvg_fill": Entry(op.add_fvg_fill, ("fvg_bull", "fvg_bear"), ("fvg_active_", "fvg_fill_pct", "fvg_age", "fvg_touched_", "fvg_partial_", "fvg_full_", "fvg_invalid_"), 3),
    "ifvg": Entry(op.add_ifvg, ("fvg_bull", "fvg_bear"), ("ifvg_",), 3),
    "order_blocks": Entry(op.add_ob, (), ("ob_bull", "ob_bear", "ob_width_atr"), 13),
    "ob_mitigation": Entry(op.add_ob_mitigation, ("ob_bull", "ob_bear"), ("ob_unmitigated_", "ob_first_retest"), 13),
    "liquidity_sweep": Entry(op.add_liquidity_sweep, (), ("sweep_",), 0),
    "equal_hl": Entry(op.add_equal_hl, (), ("equal_",), 3),
    "amd_features": Entry(op.add_amd_features, (), ("amd_box_", "amd_compression_score", "amd_overlap_score", "amd_efficiency", "amd_accumulation_active", "amd_manipulation_", "amd_distribution_", "amd_reentry_"), 0),
    "amd_state": Entry(op.add_amd_state, ("amd_accumulation_active", "amd_manipulation_candidate", "amd_manipulation_direction"), ("amd_phase", "amd_direction", "amd_sequence_id", "amd_bars_in_phase", "amd_active_box_", "amd_is_"), 0),
    "amd_labels": Entry(op.add_amd_labels, ("amd_phase", "amd_direction"), ("amd_label_",), 10),
    "prev_day": Entry(op.add_prev_day_hl, (), ("prev_day_", "above_prev_day_", "below_prev_day_"), 0),
    "prev_week": Entry(op.add_prev_week_hl, (), ("prev_week_", "above_prev_week_", "below_prev_week_"), 0),
    "asian_session": Entry(op.add_asian_session_hl, (), ("asian_",), 32),
    "round_numbers": Entry(op.add_round_number_flag, (), ("near_round_number",), 0, 0),
    "session": Entry(op.add_session_classifier, (), ("session", "london_open", "ny_open", "is_dead_zone", "hours_since_session"), 0, 0),
    "time_features": Entry(op.add_time_features, (), ("day_of_week", "is_friday", "hour_of_day"), 0, 0),
    "volume_profile": Entry(op.add_volume_profile, (), ("vp_",), 0),
    "avwap": Entry(op.add_avwap_from_last_swing, ("swing_high", "swing_low"), ("avwap",), WHOLE_SERIES),
    "regime": Entry(op.add_regime, (), ("regime",), 3, 0),
}


def entry_of(column: str) -> Entry | None:
    """The entry whose longest name or beginning of a name fits the column; None of a column that no operator makes."""
    fits = [(len(m), e.look_ahead, name) for name, e in CATALOG.items() for m in e.makes if column == m or column.startswith(m)]
    return CATALOG[max(fits)[2]] if fits else None


def live_columns(columns: Iterable[str]) -> list[str]:
    """Those of the columns that depend on no later bar; columns that no operator makes are inputs, and live."""
    return [c for c in columns if (e := entry_of(c)) is None or e.look_ahead == 0]


def cut(df: DataFrame, name: str, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """The named operator over chunks of long series; df has the columns that it needs and atr_14. A ValueError tells of an operator without a bound: see operators/chunked.py."""
    entry = CATALOG[name]
    if entry.look_back is None:
        raise ValueError(f"{name} looks back without a bound")
    takes = "keys" in signature(entry.operator).parameters
    return in_chunks(df, lambda d, k: entry.operator(d, keys=k) if takes else entry.operator(d), entry.look_back, entry.look_ahead, keys, size)
