"""Operators over candle series: each takes a DataFrame and returns it with columns added."""

from .amd import add_amd_engine, add_amd_features, add_amd_labels, add_amd_state
from .context import add_regime, add_session_classifier, add_time_features
from .foundation import add_adx, add_atr, add_bb_width, add_body_ratio, add_emas, add_foundation, add_macd, add_rolling_atr_ratio, add_rsi, compute_atr_ratio, compute_ema, ensure_atr
from .levels import add_asian_session_hl, add_avwap_from_last_swing, add_prev_day_hl, add_prev_week_hl, add_round_number_flag, add_volume_profile, compute_anchored_vwap, compute_volume_profile
from .participation import add_candle_delta_proxy, add_displacement_candle, add_key_volume_flags, add_volume_ratio, add_vsa, add_wick_ratio
from .structure import add_bos, add_choch, add_rsi_divergence, add_swings, add_swings_causal, add_trend_state, last_pivots, pivots
from .zones import add_equal_hl, add_fvg, add_fvg_fill, add_ifvg, add_liquidity_sweep, add_ob, add_ob_mitigation

__all__ = [n for n in dir() if n.startswith(("add_", "compute_", "ensure_", "pivots", "last_pivots"))]
