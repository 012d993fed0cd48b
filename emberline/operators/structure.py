"""Market structure: swings, trend state, breaks of structure, change of character, RSI divergence. Window frames throughout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import scan
from ..functions.series import FIRST, KEYS, flag, ordered, require, rows, so_far, with_bar_index
from .foundation import ensure_atr, with_atr

SIDES = (("high", 1), ("low", -1))


def wicks() -> tuple[Column, Column, Column]:
    """Upper wick, lower wick and body as shares of the bar's range, 0 without range."""
    spread = F.col("high") - F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return tuple(F.when(spread > 0, x / spread).otherwise(0.0) for x in (F.col("high") - top, bottom - F.col("low"), top - bottom))


def pivots(df: DataFrame, left: int = 2, right: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with pivot_high and pivot_low (0/1): strictly beyond `left` bars before, not behind `right` bars after, all of which exist."""
    whole = (F.count("*").over(rows(-left, -1, keys)) == left) & (F.count("*").over(rows(1, right, keys)) == right)
    high = (F.col("high") > F.max("high").over(rows(-left, -1, keys))) & (F.col("high") >= F.max("high").over(rows(1, right, keys)))
    low = (F.col("low") < F.min("low").over(rows(-left, -1, keys))) & (F.col("low") <= F.min("low").over(rows(1, right, keys)))
    return df.withColumns({"pivot_high": flag(whole & high), "pivot_low": flag(whole & low)})


def last_pivots(df: DataFrame, left: int = 2, right: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with last_pivot_high/low and their bar numbers: the latest pivot that is known, `right` bars after it."""
    df = pivots(with_bar_index(df, keys), left, right, keys)
    df = df.withColumns({f"_known_{side}_{n}": F.lag(F.when(F.col(f"pivot_{side}") == 1, F.col(c)), right).over(ordered(keys)) for side, _ in SIDES for n, c in (("price", side), ("idx", "bar_idx"))})
    out = {f"last_pivot_{side}{end}": F.last(f"_known_{side}_{n}", True).over(so_far(keys)) for side, _ in SIDES for n, end in (("price", ""), ("idx", "_idx"))}
    return df.withColumns(out).drop("pivot_high", "pivot_low", *(f"_known_{s}_{n}" for s, _ in SIDES for n in ("price", "idx")))


def _separated(df: DataFrame, name: str, separation: int, keys: Sequence[str]) -> DataFrame:
    """Of the candidates (0/1) in column name, keeps in order each that is more than separation bars after the last kept."""
    if separation <= 0:
        return df

    def start() -> Callable:
        last = -(10**9)

        def step(candidate: int, bar: int) -> tuple:
            nonlocal last
            if candidate and bar - last > separation:
                last = bar
                return (1,)
            return (0,)

        return step

    return scan(df, [(start, [name, "bar_idx"], [(name, T.IntegerType())])], keys)


def add_swings(
    df: DataFrame, window: int = 3, *, causal: bool = True, atr_length: int = 14, min_prominence_atr: float = 0.0, min_separation: int = 0, tie_mode: str = "strict", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Extremes among `window` bars on both sides. With causal, last_swing_* know a swing only when those bars have come."""
    df = ensure_atr(with_bar_index(df, keys), atr_length, keys)
    back, ahead = rows(-window, -1, keys), rows(1, window, keys)
    whole = (F.count("*").over(back) == window) & (F.count("*").over(ahead) == window)
    first: dict[str, Column] = {}
    for side, sign in SIDES:
        price = F.col(side)
        extreme, nearer = (F.max, F.greatest) if sign > 0 else (F.min, F.least)
        before, after = extreme(side).over(back), extreme(side).over(ahead)
        beyond = lambda a, b, s=sign: a > b if s > 0 else a < b
        level = lambda a, b, s=sign: a >= b if s > 0 else a <= b
        found = whole & level(price, before) & level(price, after)
        if tie_mode == "strict":
            found &= beyond(price, before) | beyond(price, after)
        prominence = (price - nearer(before, after)) * sign
        relative = F.when(F.col("atr_14") > 0, prominence / F.col("atr_14"))
        if min_prominence_atr > 0:
            found &= relative >= min_prominence_atr
        first |= {f"swing_{side}": flag(found), f"_p_{side}": prominence, f"_r_{side}": relative}
    df = df.withColumns(first)
    for side, _ in SIDES:
        df = _separated(df, f"swing_{side}", min_separation, keys)
    w = ordered(keys)
    out: dict[str, Column] = {}
    for side, _ in SIDES:
        on = F.col(f"swing_{side}") == 1
        exists = F.lead("bar_idx", window).over(w).isNotNull()
        out |= {
            f"swing_{side}_price": F.when(on, F.col(side)),
            f"swing_{side}_confirmed": F.coalesce(F.lag(f"swing_{side}", window).over(w), F.lit(0)),
            f"swing_{side}_confirm_idx": F.when(on & exists, F.col("bar_idx") + window).otherwise(-1),
            f"swing_{side}_idx": F.when(on, F.col("bar_idx")).otherwise(-1),
            f"swing_{side}_prominence": F.when(on, F.col(f"_p_{side}")),
            f"swing_{side}_prominence_atr": F.when(on, F.col(f"_r_{side}")),
            f"swing_{side}_strength": F.when(on, F.col(f"_r_{side}")),
        }
    df = df.withColumns(out).drop(*(f"_{x}_{s}" for x in "pr" for s, _ in SIDES))
    delay = window if causal else 0
    later = {}
    for side, _ in SIDES:
        later |= {f"_l_{side}": F.lag(f"swing_{side}_price", delay).over(w), f"_i_{side}": F.lag(F.when(F.col(f"swing_{side}") == 1, F.col("bar_idx")), delay).over(w)}
    df = df.withColumns(later)
    last = {}
    for side, _ in SIDES:
        last |= {f"last_swing_{side}": F.last(f"_l_{side}", True).over(so_far(keys)), f"last_swing_{side}_idx": F.last(f"_i_{side}", True).over(so_far(keys)).cast("double")}
    df = df.withColumns(last).drop(*later)
    return df.withColumns({f"swing_{side}_age": F.col("bar_idx") - F.col(f"last_swing_{side}_idx") for side, _ in SIDES})


def add_swings_causal(
    df: DataFrame, window: int = 6, *, atr_length: int = 14, min_prominence_atr: float = 0.0, min_separation: int = 1, require_rejection: bool = False, min_wick_frac: float = 0.0, max_body_frac: float = 1.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Bars that reach the extreme of the window - 1 bars before them; no look-ahead."""
    df = ensure_atr(with_bar_index(df, keys), atr_length, keys)
    back = rows(-(window - 1), -1, keys)
    upper, lower, body = wicks()
    first = {}
    for side, sign in SIDES:
        extreme = (F.max if sign > 0 else F.min)(side).over(back)
        beyond = (F.col(side) - extreme) * sign
        found = beyond >= 0
        if min_prominence_atr > 0:
            found &= F.when(F.col("atr_14") > 0, beyond / F.col("atr_14")).otherwise(0.0) >= min_prominence_atr
        if require_rejection:
            found &= ((upper if sign > 0 else lower) >= min_wick_frac) & (body <= max_body_frac)
        first[f"swing_{side}"] = flag(found)
    df = df.withColumns(first)
    for side, _ in SIDES:
        if min_separation == 1:
            # Kept are the first, third, fifth, ... of each run of neighbouring candidates.
            df = df.withColumn("_gap", F.last(F.when(F.col(f"swing_{side}") == 0, F.col("bar_idx")), True).over(so_far(keys)))
            place = F.col("bar_idx") - F.coalesce("_gap", F.lit(-1))
            df = df.withColumn(f"swing_{side}", flag((F.col(f"swing_{side}") == 1) & (place % 2 == 1))).drop("_gap")
        else:
            df = _separated(df, f"swing_{side}", min_separation, keys)
    out = {}
    for side, _ in SIDES:
        on = F.col(f"swing_{side}") == 1
        out |= {
            f"swing_{side}_price": F.when(on, F.col(side)),
            f"last_swing_{side}": F.last(F.when(on, F.col(side)), True).over(so_far(keys)),
            f"swing_{side}_age": (F.col("bar_idx") - F.last(F.when(on, F.col("bar_idx")), True).over(so_far(keys))).cast("double"),
        }
    return df.withColumns(out)


def add_trend_state(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """hh_count, ll_count and trend_state (1 up, -1 down, 0 neither yet) from the swings' prices.

    hh_count counts higher highs since the last lower high, and one more if a higher low came while that count was still 0; ll_count mirrors it.
    A state, once taken, stays until the other is.
    """
    require(df, "swing_high_price", "swing_low_price")
    df = with_bar_index(df, keys)
    before, w = rows(FIRST, -1, keys), so_far(keys)
    step = {}
    for side, _ in SIDES:
        price = F.col(f"swing_{side}_price")
        last = F.last(price, True).over(before)
        step |= {f"_up_{side}": flag(price > last), f"_down_{side}": flag(price < last)}
    df = df.withColumns(step)
    # Within a bar the high comes before the low, so a bump sees that bar's count and reset. Running counts less what they were at the
    # last reset need no partition by island, and so no other order of the rows.
    parts = (("hh_count", "_up_high", "_down_high", "_up_low"), ("ll_count", "_down_high", "_up_high", "_down_low"))
    df = df.withColumns({f"_sum_{name}": F.sum(count).over(w) for name, count, _, _ in parts})
    since = {}
    for name, _, reset, _ in parts:
        at = F.last(F.when(F.col(reset) == 1, F.struct(F.col(f"_sum_{name}").alias("n"), F.col("bar_idx").alias("i"))), True).over(w)
        since |= {f"_n_{name}": F.col(f"_sum_{name}") - F.coalesce(at["n"], F.lit(0)), f"_from_{name}": F.coalesce(at["i"], F.lit(-1))}
    df = df.withColumns(since)
    early = {f"_bump_{name}": F.max(F.when((F.col(bump) == 1) & (F.col(f"_n_{name}") == 0), F.col("bar_idx"))).over(w) for name, _, _, bump in parts}
    df = df.withColumns(early)
    df = df.withColumns({name: (F.col(f"_n_{name}") + flag(F.col(f"_bump_{name}") >= F.col(f"_from_{name}"))).cast("int") for name, _, _, _ in parts})
    step |= dict.fromkeys([f"_{x}_{name}" for x in ("sum", "n", "from", "bump") for name, _, _, _ in parts])
    state = F.when(F.col("hh_count") >= 2, 1).when(F.col("ll_count") >= 2, -1)
    return df.withColumn("trend_state", F.coalesce(F.last(state, True).over(w), F.lit(0))).drop(*step)


def add_bos(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Breaks of structure: a close beyond the last swing level, once for each level until another one is broken."""
    require(df, "last_swing_high", "last_swing_low")
    df = with_atr(with_bar_index(df, keys), keys)
    before = rows(FIRST, -1, keys)
    level = {"bull": F.col("last_swing_high"), "bear": F.col("last_swing_low")}
    beyond = {"bull": F.col("close") > level["bull"], "bear": F.col("close") < level["bear"]}
    df = df.withColumns({f"_c_{k}": F.when(beyond[k] & (F.col("bar_idx") >= 1), level[k]) for k in level})
    df = df.withColumns({f"bos_{k}": flag(F.col(f"_c_{k}").isNotNull() & ~F.col(f"_c_{k}").eqNullSafe(F.last(f"_c_{k}", True).over(before))) for k in level})
    bull, bear = F.col("bos_bull") == 1, F.col("bos_bear") == 1
    age = {s: F.col(f"swing_{s}_age") if f"swing_{s}_age" in df.columns else F.lit(None).cast("double") for s, _ in SIDES}
    body = F.when(F.col("atr_14") > 0, F.abs(F.col("close") - F.col("open")) / F.col("atr_14"))
    return df.withColumns(
        {
            "bos_direction": F.coalesce(F.last(F.when(bull, 1).when(bear, -1), True).over(so_far(keys)), F.lit(0)),
            "bos_candle_body_atr": F.when(bull | bear, body),
            "bos_swing_age": F.when(bull, age["high"]).when(bear, age["low"]).cast("double"),
        }
    ).drop("_c_bull", "_c_bear")


def add_choch(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Change of character: a break of structure against the trend state of the bar before."""
    require(df, "trend_state", "bos_bull", "bos_bear")
    df = with_atr(df, keys)
    before = F.lag("trend_state").over(ordered(keys))
    bull, bear = (before == -1) & (F.col("bos_bull") == 1), (before == 1) & (F.col("bos_bear") == 1)
    body = F.when(F.col("atr_14") > 0, F.abs(F.col("close") - F.col("open")) / F.col("atr_14"))
    return df.withColumns({"choch_bull": flag(bull), "choch_bear": flag(bear), "choch_candle_body_atr": F.when(bull | bear, body)})


def add_rsi_divergence(df: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """At a swing: a higher high in price with a lower RSI than at the swing before is bearish, a lower low with a higher RSI bullish."""
    require(df, "swing_high_price", "swing_low_price")
    if f"rsi_{period}" not in df.columns:
        from .foundation import rsi_task, smooth

        df = smooth(df, [rsi_task(period)], keys)
    before = rows(FIRST, -1, keys)
    rsi = F.col(f"rsi_{period}")
    out = {}
    for side, name, sign in (("high", "bearish", 1), ("low", "bullish", -1)):
        price = F.col(f"swing_{side}_price")
        last = F.last(F.when(price.isNotNull(), F.struct(price.alias("price"), rsi.alias("rsi"))), True).over(before)
        out[f"rsi_div_{name}"] = flag(((price - last["price"]) * sign > 0) & ((rsi - last["rsi"]) * sign < 0))
    return df.withColumns(out)
