"""Accumulation, manipulation, distribution: features, state automaton, forward labels."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import Pass, scan
from ..functions.series import KEYS, column_or, flag, full, ordered, ratio, require, rows, streak, with_bar_index
from .foundation import ensure_atr, rank_pass

UNKNOWN, ACCUMULATION, MANIPULATION, DISTRIBUTION = -1, 0, 1, 2


def _extreme(f: Callable, of: str, n: int, keys: Sequence[str]) -> Column:
    return full(f(F.col(of)), F.col(of), n, -(n - 1), 0, keys)


def add_amd_features(
    df: DataFrame, *, atr_pct_window: int = 50, accumulation_window: int = 20, overlap_window: int = 10, accumulation_min_streak: int = 8, atr_pct_low_threshold: float = 45.0, box_width_atr_max: float = 12.0, box_width_pct_max: float = 0.04,
    overlap_min: float = 0.40, efficiency_max: float = 0.35, min_touch_count_each_side: int = 1, sweep_tolerance_atr: float = 0.15, reclaim_min_frac_of_box: float = 0.10, displacement_mode: str = "break_only",
    min_distribution_followthrough_bars: int = 2, min_distribution_move_atr: float = 0.35, min_distribution_move_box_frac: float = 0.30, max_reentry_frac_of_box: float = 0.20, atr_rank: str | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The rolling box, how compressed it is, whether accumulation holds, and candidates for manipulation and distribution.

    atr_rank names a column that has the ATR's rank among atr_pct_window bars already; it goes.
    """
    if displacement_mode not in ("all", "break_only", "none"):
        raise ValueError(f"displacement_mode must be 'all', 'break_only', or 'none', got '{displacement_mode}'")
    df = ensure_atr(with_bar_index(df, keys), keys=keys)
    df = df.withColumnRenamed(atr_rank, "_pct") if atr_rank else scan(df, [rank_pass("atr_14", atr_pct_window, highest="_pct")], keys)
    w, n = ordered(keys), accumulation_window
    h, low, c, o, atr = (F.col(x) for x in ("high", "low", "close", "open", "atr_14"))
    ph, pl = F.lag(h).over(w), F.lag(low).over(w)
    shared = F.greatest(F.least(h, ph) - F.greatest(low, pl), F.lit(0.0))
    df = df.withColumns(
        {
            "amd_box_high": _extreme(F.max, "high", n, keys), "amd_box_low": _extreme(F.min, "low", n, keys),
            "_overlap": F.when(pl.isNotNull(), ratio(shared, F.greatest(h, ph) - F.least(low, pl))), "_move": F.abs(c - F.lag(c).over(w)), "_net": F.abs(c - F.lag(c, n - 1).over(w)),
        }
    )
    width = F.col("amd_box_high") - F.col("amd_box_low")
    df = df.withColumns({"amd_box_mid": (F.col("amd_box_high") + F.col("amd_box_low")) / 2, "amd_box_width": width, "amd_overlap_score": full(F.avg("_overlap"), F.col("_overlap"), overlap_window, -(overlap_window - 1), 0, keys), "amd_efficiency": ratio(F.col("_net"), full(F.sum("_move"), F.col("_move"), n, -(n - 1), 0, keys))})
    width = F.col("amd_box_width")
    # Each bar is held against its own box.
    df = df.withColumns({"_top": flag(F.abs(F.col("amd_box_high") - h) <= width * 0.10), "_bottom": flag(F.abs(low - F.col("amd_box_low")) <= width * 0.10)})
    touched = lambda x: full(F.sum(x), F.col(x), n, -(n - 1), 0, keys) >= min_touch_count_each_side
    parts = [
        F.col("_pct") <= atr_pct_low_threshold, (ratio(width, atr) <= box_width_atr_max) & (ratio(width, F.abs(c)) <= box_width_pct_max), F.col("amd_overlap_score") >= overlap_min, F.col("amd_efficiency") <= efficiency_max, touched("_top") & touched("_bottom"),
    ]
    df = df.withColumns({f"_part_{i}": flag(p) for i, p in enumerate(parts)})
    df = df.withColumn("amd_compression_score", sum((F.col(f"_part_{i}") for i in range(1, 5)), F.col("_part_0")))
    df = streak(F.col("amd_compression_score") == 5, df, "_streak", keys)
    df = df.withColumn("amd_accumulation_active", flag(F.col("_streak") >= accumulation_min_streak))
    df = df.withColumns({"_bh": F.lag("amd_box_high").over(w), "_bl": F.lag("amd_box_low").over(w), "_acc": F.coalesce(F.lag("amd_accumulation_active").over(w), F.lit(0)) == 1, "_pm": F.lag("amd_box_mid").over(w)})
    bh, bl = F.col("_bh"), F.col("_bl")
    bw = bh - bl
    displaced = F.coalesce(column_or(df, "displacement_candle", F.lit(0)), F.lit(0)) == 1
    direction = F.coalesce(F.col("displacement_direction"), F.lit(0)) if "displacement_direction" in df.columns else F.when(c > o, 1).when(c < o, -1).otherwise(0)
    tol = atr * sweep_tolerance_atr
    up, down = h > bh, low < bl
    reclaim = {1: down & (low >= bl - tol) & (c >= bl + bw * reclaim_min_frac_of_box), -1: up & (h <= bh + tol) & (c <= bh - bw * reclaim_min_frac_of_box)}
    manipulation = {}
    for sign, broke in ((1, up), (-1, down)):
        moved = displaced & (direction == sign)
        back = reclaim[sign] & moved if displacement_mode == "all" else reclaim[sign]
        away = broke if displacement_mode == "none" else broke & moved
        manipulation[sign] = F.col("_acc") & (F.coalesce(back, F.lit(False)) | F.coalesce(away, F.lit(False)))
    df = df.withColumns({"_mb": flag(manipulation[1]), "_ms": flag(manipulation[-1])})
    move = F.abs(c - F.col("_pm"))
    far = (ratio(move, atr) >= min_distribution_move_atr) & (ratio(move, bw) >= min_distribution_move_box_frac)
    inside = (c >= bl) & (c <= bh)
    buffer = bw * max_reentry_frac_of_box
    df = df.withColumns(
        {
            "amd_manipulation_candidate": F.greatest("_mb", "_ms"), "amd_manipulation_direction": F.when(F.col("_mb") == 1, 1).when(F.col("_ms") == 1, -1).otherwise(0),
            "amd_reentry_strict": flag(inside), "amd_reentry_buffered": flag((c >= bl - buffer) & (c <= bh + buffer)), "_db": flag((c > bh) & far), "_ds": flag((c < bl) & far),
        }
    )
    for x in ("_db", "_ds"):
        df = streak(F.col(x) == 1, df, f"{x}_n", keys)
    outside = F.col("amd_reentry_strict") == 0
    df = df.withColumns({f"amd_distribution_{s}_candidate": flag((F.col(f"{x}_n") >= min_distribution_followthrough_bars) & outside) for s, x in (("bull", "_db"), ("bear", "_ds"))})
    return df.drop("_pct", "_overlap", "_move", "_net", "_top", "_bottom", *(f"_part_{i}" for i in range(5)), "_streak", "_bh", "_bl", "_acc", "_pm", "_mb", "_ms", "_db", "_ds", "_db_n", "_ds_n")


def automaton(
    manipulation_timeout_bars: int = 8, allow_unknown_state: bool = True, reset_to_accumulation_on_new_box: bool = True, accumulation_grace_bars: int = 2, max_distribution_stall: int = 4,
    min_distribution_move_atr: float = 0.75, min_distribution_move_box_frac: float = 0.60, min_distribution_followthrough_bars: int = 4, min_distribution_extension_atr: float = 0.10, state: dict | None = None,
) -> Callable[..., tuple]:
    """The step of one series: a bar's values to its ten outputs. state, if given, is where it goes on, and is updated."""
    s = state if state is not None else {}
    for name, value in (("phase", UNKNOWN), ("dir", 0), ("seq", 0), ("age", 0), ("manip", 0), ("grace", 0), ("stall", 0), ("follow", 0), ("best_high", None), ("best_low", None), ("high", None), ("low", None), ("mid", None)):
        s.setdefault(name, value)

    def clear() -> None:
        s.update(manip=0, grace=0, stall=0, follow=0, best_high=None, best_low=None)

    def freeze(box: tuple) -> None:
        s["high"], s["low"], s["mid"] = box

    def accumulate(box: tuple) -> None:
        clear()
        s.update(phase=ACCUMULATION, dir=0, seq=s["seq"] + 1, age=1)
        freeze(box)

    def forget() -> None:
        clear()
        s.update(phase=UNKNOWN, dir=0, age=0)
        freeze((None, None, None))

    def leave(acc: bool, box: tuple) -> None:
        if acc and reset_to_accumulation_on_new_box:
            accumulate(box)
        elif allow_unknown_state:
            forget()

    def step(h: float, low: float, c: float, atr: float | None, acc: int, manip: int, direction: int, bh: float | None, bl: float | None, bm: float | None) -> tuple:
        acc, box, phase = acc == 1, (bh, bl, bm), s["phase"]
        bull, bear = manip == 1 and direction == 1, manip == 1 and direction == -1
        known = s["high"] is not None and s["low"] is not None
        inside = known and s["low"] <= c <= s["high"]
        away = {1: False, -1: False}
        fresh = {1: False, -1: False}
        if known and s["mid"] is not None and atr is not None and atr > 0 and (wide := s["high"] - s["low"]) > 0:
            move = abs(c - s["mid"])
            far = move / atr >= min_distribution_move_atr and move / wide >= min_distribution_move_box_frac
            more = min_distribution_extension_atr * atr
            away = {1: c > s["high"] and far, -1: c < s["low"] and far}
            fresh = {1: s["best_high"] is not None and c > s["high"] and h >= s["best_high"] + more, -1: s["best_low"] is not None and c < s["low"] and low <= s["best_low"] - more}
        if phase == UNKNOWN:
            if acc:
                accumulate(box)
            else:
                s["age"] = 0
        elif phase == ACCUMULATION:
            s["age"] += 1
            if acc:
                freeze(box)
                s["grace"] = 0
            elif bull or bear:
                clear()
                s.update(phase=MANIPULATION, dir=1 if bull else -1, manip=1, age=1)
            else:
                s["grace"] += 1
                if s["grace"] > accumulation_grace_bars and allow_unknown_state:
                    forget()
        elif phase == MANIPULATION:
            s["manip"] += 1
            s["age"] += 1
            if away[s["dir"]]:
                s["follow"] += 1
                if s["follow"] >= min_distribution_followthrough_bars:
                    s.update(phase=DISTRIBUTION, age=1, stall=0, best_high=h, best_low=low)
            else:
                s["follow"] = 0
            if s["phase"] == MANIPULATION and s["manip"] > manipulation_timeout_bars:
                leave(acc, box)
        else:
            s["age"] += 1
            if fresh[s["dir"]]:
                s["stall"] = 0
                s.update({"best_high": h} if s["dir"] == 1 else {"best_low": low})
            else:
                s["stall"] += 1
            if inside or s["stall"] > max_distribution_stall:
                leave(acc, box)
            elif acc and reset_to_accumulation_on_new_box:
                accumulate(box)
        now = s["phase"]
        return now, s["dir"], s["seq"], s["age"], s["high"], s["low"], s["mid"], int(now == ACCUMULATION), int(now == MANIPULATION), int(now == DISTRIBUTION)

    return step


AMD_INPUTS = ("high", "low", "close", "atr_14", "amd_accumulation_active", "amd_manipulation_candidate", "amd_manipulation_direction", "amd_box_high", "amd_box_low", "amd_box_mid")
_INT, _DOUBLE = T.IntegerType(), T.DoubleType()
AMD_OUTPUTS = (
    ("amd_phase", _INT), ("amd_direction", _INT), ("amd_sequence_id", _INT), ("amd_bars_in_phase", _INT), ("amd_active_box_high", _DOUBLE), ("amd_active_box_low", _DOUBLE), ("amd_active_box_mid", _DOUBLE),
    ("amd_is_accumulation", _INT), ("amd_is_manipulation", _INT), ("amd_is_distribution", _INT),
)


def amd_state_pass(**options: object) -> Pass:
    return lambda: automaton(**options), AMD_INPUTS, AMD_OUTPUTS


def add_amd_state(
    df: DataFrame, *, manipulation_timeout_bars: int = 8, allow_unknown_state: bool = True, reset_to_accumulation_on_new_box: bool = True, accumulation_grace_bars: int = 2, max_distribution_stall: int = 4,
    min_distribution_move_atr: float = 0.75, min_distribution_move_box_frac: float = 0.60, min_distribution_followthrough_bars: int = 4, min_distribution_extension_atr: float = 0.10, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Phase (-1 unknown, 0 accumulation, 1 manipulation, 2 distribution), direction, sequence, bars in phase and the box it hangs on."""
    require(df, *AMD_INPUTS[4:], error=KeyError)
    chosen = {k: v for k, v in locals().items() if k not in ("df", "keys")}
    df = ensure_atr(with_bar_index(df, keys), keys=keys)
    return scan(df, [amd_state_pass(**chosen)], keys)


def add_amd_labels(df: DataFrame, *, label_lookahead: int = 10, label_target_atr: float = 1.5, label_stop_box_frac: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """For bars in manipulation: whether target (1) or stop (-1) is touched first in the bars ahead, 0 if neither or both at once, and the
    furthest excursion ahead in ATRs. These look ahead and are labels, not features."""
    require(df, "amd_phase", "amd_direction", "amd_active_box_high", "amd_active_box_low", error=KeyError)
    df = ensure_atr(df, keys=keys)
    ahead = rows(1, label_lookahead, keys)
    c, atr, sign = F.col("close"), F.col("atr_14"), F.col("amd_direction")
    wide = F.col("amd_active_box_high") - F.col("amd_active_box_low")
    df = df.withColumns({"_h": F.collect_list("high").over(ahead), "_l": F.collect_list("low").over(ahead)})
    on = (F.col("amd_phase") == MANIPULATION) & (sign != 0) & (atr > 0) & (wide > 0) & (F.size("_h") > 0)
    target, stop = c + sign * label_target_atr * atr, c - sign * label_stop_box_frac * wide
    first = lambda xs, test: F.array_position(F.transform(xs, test), True)
    hit = F.when(sign == 1, first("_h", lambda x: x >= target)).otherwise(first("_l", lambda x: x <= target))
    out = F.when(sign == 1, first("_l", lambda x: x <= stop)).otherwise(first("_h", lambda x: x >= stop))
    df = df.withColumns({"_hit": hit, "_out": out})
    a, b = F.col("_hit"), F.col("_out")
    outcome = F.when(on & (a > 0) & ((b == 0) | (a < b)), 1).when(on & (b > 0) & ((a == 0) | (b < a)), -1).otherwise(0)
    run = F.when(sign == 1, F.array_max("_h") - c).otherwise(c - F.array_min("_l")) / atr
    return df.withColumns({"amd_label_outcome": outcome, "amd_label_forward_return_atr": F.when(on, run)}).drop("_h", "_l", "_hit", "_out")


def add_amd_engine(df: DataFrame, *, add_labels: bool = False, keys: Sequence[str] = KEYS, **kwargs: object) -> DataFrame:
    """Features, state and, if asked for, labels. Each takes the arguments it knows; names that two know go to both, unknown ones to none."""
    for operator in (add_amd_features, add_amd_state, *([add_amd_labels] if add_labels else [])):
        known = inspect.signature(operator).parameters
        df = operator(df, **{k: v for k, v in kwargs.items() if k in known}, keys=keys)
    return df
