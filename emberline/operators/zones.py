"""Price zones: fair value gaps with their fills and inversions, order blocks with their mitigation, liquidity sweeps, equal highs and lows.

Candidates are window expressions; what depends on the fate of earlier zones runs as a pass over the series with a short list of live zones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import fmean, median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import Pass, scan
from ..functions.series import KEYS, flag, ordered, ratio, require, rows, with_bar_index
from .foundation import ensure_atr
from .structure import last_pivots, pivots, wicks

INT, DOUBLE = T.IntegerType(), T.DoubleType()
BULL_BEAR = ("bull", "bear")
DEPTHS = ("any", "mid", "deep")


def _gap(side: str, mode: str, keys: Sequence[str]) -> tuple[Column, Column]:
    """Lower and upper edge of the gap that the bars around this one leave; the upper is above the lower if there is one."""
    w = ordered(keys)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    near = {"wick": ("high", "low"), "hybrid": ("high", "low"), "body": (top, bottom)}[mode if mode in ("body", "hybrid") else "wick"]
    far = {"wick": ("high", "low"), "hybrid": (top, bottom), "body": (top, bottom)}[mode if mode in ("body", "hybrid") else "wick"]
    if side == "bull":
        return F.lag(near[0]).over(w), F.lead(far[1]).over(w)
    return F.lead(far[0]).over(w), F.lag(near[1]).over(w)


def fvg_candidates(
    df: DataFrame, min_atr_mult: float = 0.3, *, atr_length: int = 14, mode: str = "wick", require_displacement: bool = True, displacement_body_atr_mult: float = 0.8, require_bos: bool = False,
    swing_left: int = 2, swing_right: int = 2, merge_overlaps: bool = True, merge_max_gap_bars: int = 2, keep_strongest_only_within: int = 0, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """df with what fvg_pass reads: for each bar and side the candidate gaps from it to as far ahead as a zone reaches."""
    df = last_pivots(ensure_atr(with_bar_index(df, keys), atr_length, keys), swing_left, swing_right, keys)
    w = ordered(keys)
    atr = F.col("atr_14")
    body = ratio(F.abs(F.col("close") - F.col("open")), atr)
    usable = (atr > 0) & F.lag("close").over(w).isNotNull() & F.lead("close").over(w).isNotNull()
    after = F.lead("close").over(w)
    for side in BULL_BEAR:
        low, high = _gap(side, mode, keys)
        level = F.lead("last_pivot_high" if side == "bull" else "last_pivot_low").over(w)
        bos = flag(after > level if side == "bull" else after < level)
        found = usable & (high - low > 0) & (high - low >= min_atr_mult * atr)
        if require_displacement:
            found &= body >= displacement_body_atr_mult
        if require_bos:
            found &= bos == 1
        found = F.coalesce(found, F.lit(False))
        df = df.withColumn(f"_{side}", F.when(found, F.struct(low.alias("lo"), high.alias("hi"), ratio(high - low, atr).alias("size"), body.alias("body"), bos.alias("bos"))))
        if keep_strongest_only_within > 0:
            k = keep_strongest_only_within
            best = F.max(F.when(F.col(f"_{side}").isNotNull(), F.struct(F.col(f"_{side}.size"), -F.col("bar_idx")))).over(rows(-k, k, keys))
            df = df.withColumn(f"_{side}", F.when(-best["col2"] == F.col("bar_idx"), F.col(f"_{side}")))
    df = df.drop("last_pivot_high", "last_pivot_low", "last_pivot_high_idx", "last_pivot_low_idx")
    # A zone takes in what comes up to reach bars later, so each row sees the candidates ahead of it.
    reach = merge_max_gap_bars if merge_overlaps else 0
    df = df.withColumns({f"_next_{side}": F.collect_list(F.when(F.col(f"_{side}").isNotNull(), F.struct("bar_idx", F.col(f"_{side}").alias("gap")))).over(rows(0, reach, keys)) for side in BULL_BEAR})
    return df.drop("_bull", "_bear")


def fvg_pass() -> Pass:
    """Merges candidates into zones: one takes in what overlaps it within its reach, and stays at its first bar."""

    def start() -> Callable:
        taken = {side: -1 for side in BULL_BEAR}

        def merge(side: str, bar: int, ahead: list) -> dict | None:
            if not ahead or ahead[0]["bar_idx"] != bar or bar <= taken[side]:
                return None
            z = dict(ahead[0]["gap"], idx=bar, confirm=bar + 1)
            for a in ahead[1:]:
                c = a["gap"]
                if z["lo"] > c["hi"] or c["lo"] > z["hi"]:
                    break
                z |= {"lo": min(z["lo"], c["lo"]), "hi": max(z["hi"], c["hi"]), "confirm": a["bar_idx"] + 1, **{k: max(z[k], c[k]) for k in ("size", "body", "bos")}}
                taken[side] = a["bar_idx"]
            return z

        def step(bar: int, bulls: list, bears: list) -> tuple:
            b, s = merge("bull", bar, bulls), merge("bear", bar, bears)
            one = b or s
            return (
                int(b is not None), int(s is not None), b and b["lo"], b and b["hi"], s and s["hi"], s and s["lo"], one and one["size"], b["confirm"] if b else -1, s["confirm"] if s else -1,
                one and float(one["confirm"] - bar), one and one["body"], b["bos"] if b else 0, s["bos"] if s else 0,
            )

        return step

    outputs = [
        ("fvg_bull", INT), ("fvg_bear", INT), ("fvg_bull_low", DOUBLE), ("fvg_bull_high", DOUBLE), ("fvg_bear_high", DOUBLE), ("fvg_bear_low", DOUBLE), ("fvg_size_atr", DOUBLE),
        ("fvg_bull_confirm_idx", INT), ("fvg_bear_confirm_idx", INT), ("fvg_confirm_delay", DOUBLE), ("fvg_mid_body_atr", DOUBLE), ("fvg_bos_bull", INT), ("fvg_bos_bear", INT),
    ]
    return start, ["bar_idx", "_next_bull", "_next_bear"], outputs


def add_fvg(df: DataFrame, min_atr_mult: float = 0.3, *, keys: Sequence[str] = KEYS, **options: object) -> DataFrame:
    """Fair value gaps of three bars, written at the middle one; known at fvg_*_confirm_idx. Options are those of fvg_candidates.

    Overlapping gaps of a side whose first bars are at most merge_max_gap_bars apart are one, at the first's bar.
    """
    return scan(fvg_candidates(df, min_atr_mult, keys=keys, **options), [fvg_pass()], keys).drop("_next_bull", "_next_bear")


_ZONE_INPUTS = ["bar_idx", "high", "low", "close", "atr_14", *(f"fvg_{s}{x}" for s in BULL_BEAR for x in ("", "_low", "_high", "_confirm_idx"))]


def _with_zones(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of gaps it lacks, as if there were none."""
    df = ensure_atr(with_bar_index(df, keys), keys=keys)
    default = {"": F.lit(0), "_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double"), "_confirm_idx": F.lit(-1)}
    return df.withColumns({f"fvg_{s}{x}": v for s in BULL_BEAR for x, v in default.items() if f"fvg_{s}{x}" not in df.columns})


class Zone:
    __slots__ = ("lo", "hi", "confirm", "fill", "state", "broken")

    def __init__(self, lo: float, hi: float, confirm: int) -> None:
        self.lo, self.hi, self.confirm, self.fill, self.state, self.broken = lo, hi, confirm, 0.0, 1, -1


def _registered(zones: list[Zone], bar: int, on: int, lo: float | None, hi: float | None, confirm: int, keep: int) -> list[Zone]:
    if on == 1 and lo is not None:
        zones = [*zones, Zone(lo, hi, confirm if confirm >= 0 else bar + 1)][-keep:]
    return zones


def fvg_fill_pass(
    *, track_last_n_bull: int = 5, track_last_n_bear: int = 5, fill_measure: str = "extreme", invalidate_on_close_through: bool = False, remove_fully_filled: bool = True,
) -> Pass:
    """How far later bars have filled the live gaps of each side; the shared columns are of the side filled further, bull on a tie."""
    keep = {"bull": track_last_n_bull, "bear": track_last_n_bear}

    def start() -> Callable:
        live: dict[str, list[Zone]] = {s: [] for s in BULL_BEAR}

        def side_step(side: str, bar: int, h: float, low: float, c: float) -> tuple:
            bull = side == "bull"
            price = c if fill_measure == "close" else (h + low) / 2 if fill_measure == "mid" else low if bull else h
            touched = partial = whole = invalid = 0
            best = age = None
            still = []
            for z in live[side]:
                alive = True
                if bar > z.confirm:
                    size = z.hi - z.lo
                    depth = z.hi - price if bull else price - z.lo
                    fill = min(max(depth, 0.0) / size, 1.0) if size > 0 else 0.0
                    z.fill = max(z.fill, fill)
                    touched |= fill > 0
                    partial |= 0 < fill < 1
                    if fill >= 1:
                        whole = 1
                        alive = not remove_fully_filled
                    if invalidate_on_close_through and (c < z.lo if bull else c > z.hi):
                        invalid, alive = 1, False
                    if alive and (best is None or z.fill > best):
                        best, age = z.fill, float(bar - z.confirm)
                if alive:
                    still.append(z)
            live[side] = still
            return int(best is not None), best, age, int(touched), int(partial), whole, invalid

        def step(bar: int, h: float, low: float, c: float, _: float, *gaps: float) -> tuple:
            made = []
            for k, side in enumerate(BULL_BEAR):
                on, lo, hi, confirm = gaps[4 * k : 4 * k + 4]
                live[side] = _registered(live[side], bar, on, lo, hi, confirm, keep[side])
                made.append(side_step(side, bar, h, low, c))
            b, s = made
            one = max((x for x in made if x[1] is not None), key=lambda x: x[1], default=(0, None, None))
            return b[0], s[0], one[1], one[2], b[1], s[1], b[2], s[2], b[3], s[3], b[4], s[4], b[5], s[5], b[6], s[6]

        return step

    outputs = [("fvg_active_bull", INT), ("fvg_active_bear", INT), ("fvg_fill_pct", DOUBLE), ("fvg_age", DOUBLE)]
    outputs += [(f"fvg_{n}_{s}", t) for n, t in (("fill_pct", DOUBLE), ("age", DOUBLE), ("touched", INT), ("partial", INT), ("full", INT), ("invalid", INT)) for s in BULL_BEAR]
    return start, _ZONE_INPUTS, outputs


def add_fvg_fill(df: DataFrame, *, keys: Sequence[str] = KEYS, **options: object) -> DataFrame:
    """See fvg_fill_pass."""
    return scan(_with_zones(df, keys), [fvg_fill_pass(**options)], keys)


def ifvg_pass(
    *, require_retest: bool = True, retest_mode: str = "any", track_last_n_bull: int = 5, track_last_n_bear: int = 5, remove_confirmed: bool = False,
) -> Pass:
    """Inversions: a gap that a close breaks through, and that is then retested from the other side. States: 1 open, 3 broken, 4 inverted.

    A bull gap inverts to a bear one and the other way round. A zone takes part until newer ones of its side push it out.
    """
    depth = DEPTHS.index(retest_mode) if retest_mode in DEPTHS else 0
    keep = {"bull": track_last_n_bull, "bear": track_last_n_bear}

    def start() -> Callable:
        live: dict[str, list[Zone]] = {s: [] for s in BULL_BEAR}

        def side_step(side: str, bar: int, h: float, low: float, c: float) -> tuple:
            """Of the gaps of one side, what they say of the other: inverted, width, broken, retested, state, origin."""
            bull = side == "bull"
            inverted = broken = retested = 0
            width = None
            for z in live[side]:
                if bar <= z.confirm:
                    continue
                if z.state == 1 and (c < z.lo if bull else c > z.hi):
                    z.state, z.broken, broken = (3 if require_retest else 4), bar, 1
                    if not require_retest:
                        inverted, width = 1, z.hi - z.lo
                elif z.state == 3 and bar > z.broken:
                    levels = (z.lo, (z.lo + z.hi) / 2, z.hi) if bull else (z.hi, (z.lo + z.hi) / 2, z.lo)
                    if h >= levels[depth] if bull else low <= levels[depth]:
                        z.state, retested, inverted, width = 4, 1, 1, z.hi - z.lo
            best = max(((z.state, z.confirm) for z in live[side]), default=(0, -1))
            return inverted, width, broken, retested, best[0], best[1]

        def step(bar: int, h: float, low: float, c: float, atr: float | None, *gaps: float) -> tuple:
            for k, side in enumerate(BULL_BEAR):
                on, lo, hi, confirm = gaps[4 * k : 4 * k + 4]
                live[side] = _registered(live[side], bar, on, lo, hi, confirm, keep[side])
            bear, bull = side_step("bull", bar, h, low, c), side_step("bear", bar, h, low, c)
            width = bull[1] if bull[0] else bear[1]
            return bull[0], bear[0], width / atr if width is not None and atr and atr > 0 else None, bull[2], bear[2], bull[2], bear[2], bull[3], bear[3], bull[4], bear[4], bull[5], bear[5]

        return step

    outputs = [("ifvg_bull", INT), ("ifvg_bear", INT), ("ifvg_width_atr", DOUBLE)]
    outputs += [(f"ifvg_{s}_{n}", INT) for n in ("break", "candidate", "retest") for s in BULL_BEAR] + [(f"ifvg_{n}_{s}", INT) for n in ("state", "origin_idx") for s in BULL_BEAR]
    return start, _ZONE_INPUTS, outputs


def add_ifvg(df: DataFrame, *, atr_length: int = 14, keys: Sequence[str] = KEYS, **options: object) -> DataFrame:
    """See ifvg_pass."""
    return scan(_with_zones(ensure_atr(df, atr_length, keys), keys), [ifvg_pass(**options)], keys)


def add_ob(
    df: DataFrame, impulse_candles: int = 4, impulse_atr_mult: float = 1.5, *, atr_length: int = 14, swing_left: int = 2, swing_right: int = 2, searchback: int = 10, min_same_dir_frac: float = 0.67,
    require_bos: bool = True, zone_mode: str = "openwick", max_ob_width_atr: float = 3.0, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Order blocks: the last candle against an impulse that breaks structure, if its zone is not too wide; written at that candle."""
    df = last_pivots(ensure_atr(with_bar_index(df, keys), atr_length, keys), swing_left, swing_right, keys)
    w, n = ordered(keys), impulse_candles
    window = rows(-(n - 1), 0, keys)
    atr, o, h, low, c = (F.col(x) for x in ("atr_14", "open", "high", "low", "close"))
    whole = (F.count("*").over(window) == n) & (F.col("bar_idx") >= max(n - 1, 1)) & (atr > 0)
    top, bottom = F.greatest(o, c), F.least(o, c)
    # Which edges of a candle bound its zone, by side.
    edges = {"body": {"bull": (top, bottom), "bear": (top, bottom)}, "openwick": {"bull": (o, low), "bear": (h, o)}}.get(zone_mode, {"bull": (h, low), "bear": (h, low)})
    for side, sign in (("bull", 1), ("bear", -1)):
        with_it = F.sum(flag((c - o) * sign > 0)).over(window) / n
        moved = c - F.min(low).over(window) if sign > 0 else F.max(h).over(window) - c
        bodies = F.sum(F.greatest((c - o) * sign, F.lit(0.0))).over(window)
        impulse = whole & (with_it >= min_same_dir_frac) & (moved >= impulse_atr_mult * atr) & (bodies >= 0.8 * atr) & ((c - F.lag(c, n - 1).over(w)) * sign > 0)
        if require_bos:
            impulse &= ((h > F.col("last_pivot_high")) & (c > F.col("last_pivot_high"))) if sign > 0 else ((low < F.col("last_pivot_low")) & (c < F.col("last_pivot_low")))
        hi, lo = edges[side]
        against = F.when((c - o) * sign < 0, F.struct(F.col("bar_idx").alias("k"), hi.alias("hi"), lo.alias("lo")))
        df = df.withColumns({f"_on_{side}": flag(impulse), f"_past_{side}": F.collect_list(against).over(rows(-(n - 1 + searchback), -n, keys))})
    # An impulse at bar i points at one of the bars i - n - searchback + 1 to i - n, so a bar finds all that point at it in as many bars ahead.
    pointers = {}
    for side in BULL_BEAR:
        nearest = F.element_at(F.filter(f"_past_{side}", lambda z: ratio(z["hi"] - z["lo"], F.col("atr_14")) <= max_ob_width_atr), -1)
        some = F.exists(f"_past_{side}", lambda z: ratio(z["hi"] - z["lo"], F.col("atr_14")) <= max_ob_width_atr)
        point = F.struct("bar_idx", nearest["k"].alias("k"), nearest["hi"].alias("hi"), nearest["lo"].alias("lo"), ratio(nearest["hi"] - nearest["lo"], F.col("atr_14")).alias("width"))
        pointers[f"_to_{side}"] = F.when((F.col(f"_on_{side}") == 1) & some, point)
    df = df.withColumns(pointers)
    ahead = rows(n, n - 1 + searchback, keys)
    df = df.withColumns({f"_by_{s}": F.collect_list(f"_to_{s}").over(ahead) for s in BULL_BEAR})
    df = df.withColumns({f"_by_{s}": F.get(F.filter(f"_by_{s}", lambda p: p["k"] == F.col("bar_idx")), F.lit(0)) for s in BULL_BEAR})
    out = {f"ob_{s}": flag(F.col(f"_by_{s}").isNotNull()) for s in BULL_BEAR} | {f"ob_{s}_{name}": F.col(f"_by_{s}.{x}") for s in BULL_BEAR for name, x in (("high", "hi"), ("low", "lo"))}
    # Of impulses of both sides at one candle the earlier one's ATR measures the width.
    out["ob_width_atr"] = F.coalesce(F.when(F.col("_by_bear.bar_idx") < F.col("_by_bull.bar_idx"), F.col("_by_bear.width")), F.col("_by_bull.width"), F.col("_by_bear.width"))
    used = [f"_{x}_{s}" for x in ("on", "past", "to", "by") for s in BULL_BEAR]
    return df.withColumns(out).drop(*used, "last_pivot_high", "last_pivot_low", "last_pivot_high_idx", "last_pivot_low_idx")


def ob_mitigation_pass(*, keep_last_n: int = 3, by_side: bool = False) -> Pass:
    """Whether a recent order block of each side is unbroken, and the bars that first come back to one; by_side: to one of which side, too, and the newest such block's edges."""

    def start() -> Callable:
        live: dict[str, list[Zone]] = {s: [] for s in BULL_BEAR}

        def step(bar: int, h: float, low: float, *blocks: float) -> tuple:
            any_, retests, edges = [], [], []
            for k, side in enumerate(BULL_BEAR):
                retest, met = 0, None
                on, hi, lo = blocks[3 * k : 3 * k + 3]
                if hi is not None:
                    live[side] = _registered(live[side], bar, on, lo, hi, bar, keep_last_n)
                still = []
                for z in live[side]:
                    if bar > z.confirm and (low <= z.hi if side == "bull" else h >= z.lo):
                        if z.state == 1:
                            z.state, retest, met = 2, 1, z
                        if low < z.lo if side == "bull" else h > z.hi:
                            continue
                    still.append(z)
                live[side] = still
                any_.append(int(bool(still)))
                retests.append(retest)
                edges += [met and met.lo, met and met.hi]
            return (*any_, max(retests), *((*retests, *edges) if by_side else ()))

        return step

    inputs = ["bar_idx", "high", "low", *(f"ob_{s}{x}" for s in BULL_BEAR for x in ("", "_high", "_low"))]
    outputs = [("ob_unmitigated_bull", INT), ("ob_unmitigated_bear", INT), ("ob_first_retest", INT)]
    sides = [(f"ob_first_retest_{s}", INT) for s in BULL_BEAR] + [(f"ob_first_retest_{s}_{x}", DOUBLE) for s in BULL_BEAR for x in ("low", "high")]
    return start, inputs, outputs + sides * by_side


def add_ob_mitigation(df: DataFrame, *, keep_last_n: int = 3, by_side: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """See ob_mitigation_pass; without order blocks there is nothing to watch."""
    df = with_bar_index(df, keys)
    none = F.lit(None).cast("double")
    df = df.withColumns({f"ob_{s}{x}": v for s in BULL_BEAR for x, v in (("", F.lit(0)), ("_high", none), ("_low", none)) if f"ob_{s}{x}" not in df.columns})
    return scan(df, [ob_mitigation_pass(keep_last_n=keep_last_n, by_side=by_side)], keys)


def add_liquidity_sweep(
    df: DataFrame, atr_threshold: float = 0.2, *, atr_length: int = 14, swing_left: int = 2, swing_right: int = 2, level_tolerance_atr: float = 0.0, min_reclaim_atr: float = 0.0, min_wick_frac: float = 0.25, max_body_frac: float = 0.8,
    max_level_age: int | None = 80, require_next_bar_confirmation: bool = False, confirmation_mode: str = "close", use_provided_swings: bool = True, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Bars whose wick goes beyond the last swing level and that close back inside."""
    require(df, "open", "high", "low", "close")
    df = ensure_atr(with_bar_index(df, keys), atr_length, keys)
    if use_provided_swings and {"last_swing_high", "last_swing_low"} <= set(df.columns):
        none = F.lit(None).cast("double")
        df = df.withColumns({x: v for s in ("high", "low") for x, v in ((f"_level_{s}", F.col(f"last_swing_{s}")), (f"_age_{s}", F.col(f"swing_{s}_age") if f"swing_{s}_age" in df.columns else none))})
    else:
        df = last_pivots(df, swing_left, swing_right, keys)
        df = df.withColumns({x: v for s in ("high", "low") for x, v in ((f"_level_{s}", F.col(f"last_pivot_{s}")), (f"_age_{s}", (F.col("bar_idx") - F.col(f"last_pivot_{s}_idx")).cast("double")))})
        df = df.drop(*(f"last_pivot_{s}{x}" for s in ("high", "low") for x in ("", "_idx")))
    upper, lower, body = wicks()
    atr, c = F.col("atr_14"), F.col("close")
    after = F.lead("close").over(ordered(keys))
    middle = (F.col("open") + c) / 2
    df = df.withColumns({"_upper": upper, "_lower": lower, "_body": body})
    out: dict[str, Column] = {}
    for side, sign in (("high", 1), ("low", -1)):
        level, wick = F.col(f"_level_{side}"), F.col("_upper" if sign > 0 else "_lower")
        beyond, inside = (F.col(side) - level) * sign, (level - c) * sign
        tol = level_tolerance_atr * atr
        found = (F.col("bar_idx") >= 1) & (atr > 0) & (beyond > tol) & (inside > tol) & (ratio(beyond, atr) >= atr_threshold) & (ratio(inside, atr) >= min_reclaim_atr) & (wick >= min_wick_frac) & (F.col("_body") <= max_body_frac)
        if max_level_age is not None:
            found &= F.col(f"_age_{side}") <= max_level_age
        if require_next_bar_confirmation:
            own = "low" if sign > 0 else "high"
            past = {"mid": middle, own: F.col(own)}.get(confirmation_mode, c)
            found &= (past - after) * sign > 0
        out |= {f"sweep_{side}": flag(found), f"_m_{side}": ratio(beyond, atr), f"_r_{side}": ratio(inside, atr)}
    df = df.withColumns(out)
    done: dict[str, Column] = {}
    for side in ("high", "low"):
        on = F.col(f"sweep_{side}") == 1
        when = lambda x, on=on: F.when(on, x)
        done |= {
            f"sweep_{side}_magnitude": when(F.col(f"_m_{side}")), f"sweep_{side}_reclaim_atr": when(F.col(f"_r_{side}")), f"sweep_{side}_wick_frac": when(F.col("_upper" if side == "high" else "_lower")),
            f"sweep_{side}_body_frac": when(F.col("_body")), f"sweep_level_{side}": when(F.col(f"_level_{side}")), f"sweep_level_{side}_age": when(F.col(f"_age_{side}").cast("double")), f"sweep_confirmed_{side}": F.col(f"sweep_{side}"),
        }
    df = df.withColumns(done)
    df = df.withColumns({"sweep_magnitude": F.greatest("sweep_high_magnitude", "sweep_low_magnitude"), "sweep_side": F.col("sweep_high") - F.col("sweep_low")})
    return df.drop("_upper", "_lower", "_body", *(f"_{x}_{s}" for x in ("level", "age", "m", "r") for s in ("high", "low")))


class _Cluster:
    __slots__ = ("id", "prices", "first", "last", "level", "width", "width_atr", "span", "score", "active")

    def __init__(self, id_: int, price: float, bar: int) -> None:
        self.id, self.prices, self.first, self.last, self.level = id_, [price], bar, bar, price
        self.width, self.width_atr, self.span, self.score, self.active = 0.0, 0.0, 0, 1.0, True


def equal_hl_candidates(df: DataFrame, *, atr_length: int = 14, swing_left: int = 2, swing_right: int = 2, use_provided_swings: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with what equal_hl_pass reads: the price of the swing, if any, at each bar and side."""
    require(df, "high", "low", "close")
    df = ensure_atr(with_bar_index(df, keys), atr_length, keys)
    if use_provided_swings and {"swing_high_price", "swing_low_price"} <= set(df.columns):
        price = {s: F.col(f"swing_{s}_price") for s in ("high", "low")}
        price = {s: F.when(F.col(f"swing_{s}") == 1, p) if f"swing_{s}" in df.columns else p for s, p in price.items()}
    else:
        df = pivots(df, swing_left, swing_right, keys)
        price = {s: F.when(F.col(f"pivot_{s}") == 1, F.col(s)) for s in ("high", "low")}
    return df.withColumns({f"_price_{s}": p for s, p in price.items()}).drop("pivot_high", "pivot_low")


def equal_hl_pass(
    atr_tolerance: float = 0.1, *, lookback_swings: int = 50, min_touches: int = 2, level_mode: str = "median", max_cluster_width_atr: float | None = None, max_cluster_span: int | None = None,
    invalidate_on_sweep: bool = False, sweep_tolerance_atr: float = 0.0, keep_last_n_clusters: int = 20,
) -> Pass:
    """Swings at nearly the same price: each joins the nearest live cluster within the tolerance or begins one.

    At a swing whose cluster has enough touches the columns describe it; later bars repeat the latest such description while it was active.
    A cluster ends when its last touch is more than lookback_swings bars old.
    """
    level_of = {"mean": fmean, "first": lambda v: v[0], "last": lambda v: v[-1]}.get(level_mode, median)

    def start() -> Callable:
        clusters: dict[str, list[_Cluster]] = {"high": [], "low": []}
        ids = {"high": 0, "low": 0}
        shown: dict[str, tuple | None] = {"high": None, "low": None}

        def touch(side: str, bar: int, price: float, atr: float | None) -> _Cluster:
            clusters[side] = [x for x in clusters[side] if bar - x.last <= lookback_swings]
            tolerance = atr_tolerance * atr if atr and atr > 0 else 0.0
            near = [x for x in clusters[side] if x.active and abs(price - x.level) <= tolerance]
            if not near:
                x = _Cluster(ids[side], price, bar)
                ids[side] += 1
                clusters[side].append(x)
                return x
            x = min(near, key=lambda x: abs(price - x.level))
            x.prices.append(price)
            x.last, x.span, x.level, x.width = bar, bar - x.first, level_of(x.prices), max(x.prices) - min(x.prices)
            x.width_atr = x.width / atr if atr and atr > 0 else None
            x.score = len(x.prices) / (1.0 + max(x.width_atr or 0.0, 0.0)) * (1.0 + 0.1 * math.log1p(max(x.span, 0)))
            return x

        def side_step(side: str, bar: int, extreme: float, atr: float | None, price: float | None) -> tuple:
            if invalidate_on_sweep:
                tol = sweep_tolerance_atr * atr if atr and atr > 0 else 0.0
                for x in clusters[side]:
                    if x.active and (extreme > x.level + tol if side == "high" else extreme < x.level - tol):
                        x.active = False
            out = None
            if price is not None:
                x = touch(side, bar, price, atr)
                narrow = max_cluster_width_atr is None or x.width_atr is None or x.width_atr <= max_cluster_width_atr
                if len(x.prices) >= min_touches and narrow and (max_cluster_span is None or x.span <= max_cluster_span):
                    shown[side] = (len(x.prices), x.level, x.width, x.width_atr, float(x.span), int(x.active), x.score)
                    n, level, width, width_atr, span, active, score = shown[side]
                    out = (1, n, level, width, width_atr, 0.0, span, active, score, x.id)
            # A step adds one cluster at most: one too many leaves, an inactive one first, then the one longest untouched, of those the newest.
            if len(clusters[side]) > keep_last_n_clusters:
                clusters[side].remove(min(clusters[side], key=lambda x: (x.active, x.last, -x.id)))
            if out is None:
                if shown[side] and shown[side][5]:
                    n, level, width, width_atr, span, _, score = shown[side]
                    return 0, n, level, width, width_atr, None, span, 1, score, -1
                return 0, 0, None, None, None, None, None, 0, None, -1
            return out

        def step(bar: int, h: float, low: float, atr: float | None, ph: float | None, pl: float | None) -> tuple:
            return (*side_step("high", bar, h, atr, ph), *side_step("low", bar, low, atr, pl))

        return step

    names = (("", INT), ("_count", INT), ("_level", DOUBLE), ("_width", DOUBLE), ("_width_atr", DOUBLE), ("_age", DOUBLE), ("_span", DOUBLE), ("_active", INT), ("_score", DOUBLE), ("_cluster_id", INT))
    outputs = [(f"equal_{s}{n}", t) for s in ("highs", "lows") for n, t in names]
    return start, ["bar_idx", "high", "low", "atr_14", "_price_high", "_price_low"], outputs


def add_equal_hl(
    df: DataFrame, atr_tolerance: float = 0.1, *, atr_length: int = 14, swing_left: int = 2, swing_right: int = 2, use_provided_swings: bool = True, keys: Sequence[str] = KEYS, **options: object
) -> DataFrame:
    """See equal_hl_pass."""
    df = equal_hl_candidates(df, atr_length=atr_length, swing_left=swing_left, swing_right=swing_right, use_provided_swings=use_provided_swings, keys=keys)
    return scan(df, [equal_hl_pass(atr_tolerance, **options)], keys).drop("_price_high", "_price_low")
