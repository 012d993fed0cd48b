"""Smoothers and market structure of long series: the columns of `foundation` and `structure`, with a series in many tasks.

Operators whose frames are bounded run as they are by `in_chunks`. Here are those that carry something without bound; each level of what depends on what
is a table in the shared folder, so nothing is computed twice on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunks import CHUNK, SIZE, Carry, carried, ema, in_chunks, joined, numbered, rma, smoothed, wilder_sum, within
from ..functions.scan import Pass, scan
from ..functions.series import FIRST, KEYS, ORDER, flag, ordered, rows
from ..functions.shared import stored
from .foundation import adx_columns, bollinger, emas, macd_columns, rsi_columns, true_range
from .structure import SIDES, add_swings

FAMILIES = ("atr", "emas", "adx", "rsi", "macd", "bb_width")


def rolling_rank(col: str, n: int, keys: Sequence[str]) -> Column:
    """Percentile rank (0-100) of a value among the last n by the average of its ties, NULL unless there are n. Values alike in ten significant digits are ties."""
    value = F.format_string("%.9e", col).cast("double")
    known = F.collect_list(F.when(F.col(col).isNotNull(), value)).over(rows(-(n - 1), 0, keys))
    below, level = F.size(F.filter(known, lambda v: v < value)), F.size(F.filter(known, lambda v: v == value))
    return F.when(F.col(col).isNotNull() & (F.size(known) == n), (below + (level + 1) / 2) / n * 100)


def add_foundation_in_chunks(df: DataFrame, families: Sequence[str] = FAMILIES, periods: Sequence[int] = (20, 50, 200), period: int = 14, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """The columns of add_atr, add_emas, add_adx, add_rsi, add_macd and add_bb_width (those of `families`) with their default parameters but for periods and period; bar_idx stays."""

    def helpers(d: DataFrame, k: Sequence[str]) -> DataFrame:
        w = ordered(k)
        up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
        change = F.col("close").cast("double") - F.lag("close").over(w)
        return d.withColumns({
            "_tr": true_range(k), "_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0)), "_change": change,
            "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }).withColumns({c: F.when(F.col("_change").isNotNull(), F.col(c)) for c in ("_up", "_down")})

    first = {f"atr_{period}": rma("_tr", period)} if {"atr", "emas"} & {*families} else {}
    first |= {f"ema_{p}": ema("close", p) for p in periods} if "emas" in families else {}
    first |= {f"_{n}_sum": wilder_sum(f"_{n}", period) for n in ("tr", "plus", "minus")} if "adx" in families else {}
    first |= {f"_{n}_mean": rma(f"_{n}", period) for n in ("up", "down")} if "rsi" in families else {}
    first |= {f"_ema_{p}": ema("close", p) for p in (12, 26)} if "macd" in families else {}
    made = stored(in_chunks(df, helpers, 1, 0, keys, size), "bars")
    made = smoothed(made, first, keys, size) if first else made
    second = {}
    if "adx" in families:
        share = lambda n: F.when(F.col("_tr_sum") > 0, 100 * F.col(f"_{n}_sum") / F.col("_tr_sum")).otherwise(0.0)
        made = made.withColumns({f"dmp_{period}": share("plus"), f"dmn_{period}": share("minus")})
        both = F.col(f"dmp_{period}") + F.col(f"dmn_{period}")
        made = made.withColumn("_dx", F.when(both > 0, F.abs(F.col(f"dmp_{period}") - F.col(f"dmn_{period}")) / both * 100).otherwise(0.0))
        second[f"adx_{period}"] = rma("_dx", period)
    if "rsi" in families:
        gain, loss = F.col("_up_mean"), F.col("_down_mean")
        value = F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100.0 - 100.0 / (1.0 + gain / loss))
        made = made.withColumn(f"rsi_{period}", F.when(F.col("_change").isNotNull(), value))
    if "macd" in families:
        made = made.withColumn("macd", F.col("_ema_12") - F.col("_ema_26"))
        second["macd_signal"] = ema("macd", 9)
    if second:
        made = smoothed(stored(made, "smoothed"), second, keys, size)
    if "macd" in families:
        made = made.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))

    def last(d: DataFrame, k: Sequence[str]) -> DataFrame:
        if "bb_width" in families:
            low, middle, high = bollinger(keys=k)
            d = d.withColumn("bb_width", F.try_divide(high - low, middle))
            d = d.withColumn("bb_width_pct_50", rolling_rank("bb_width", 50, k))
            d = d.withColumns({f"bb_width_below_{x}": flag(F.col("bb_width_pct_50") < x) for x in (30, 40)})
        d = d.withColumn("atr_pct_50", rolling_rank(f"atr_{period}", 50, k)) if "atr" in families else d
        d = emas(d, periods, k) if "emas" in families else d
        d = adx_columns(d, period, k) if "adx" in families else d
        d = rsi_columns(d, period, k) if "rsi" in families else d
        return macd_columns(d, k) if "macd" in families else d

    # A rank looks 49 bars back at bands that look 19 back.
    out = in_chunks(made, last, 70, 0, keys, size)
    return out.drop(CHUNK, "_tr", "_up", "_down", "_change", "_plus", "_minus", "_dx", *(n for n in first if n.startswith("_")))


def ensure_atr_in_chunks(df: DataFrame, length: int = 14, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """df with atr_14 as ensure_atr gives it, bar_idx and chunk."""
    if "atr_14" in df.columns:
        return numbered(df, keys, size)
    made = stored(in_chunks(df, lambda d, k: d.withColumn("_tr0", true_range(k, first_close=True)), 1, 0, keys, size), "bars")
    return smoothed(made, {"atr_14": rma("_tr0", length, early=True)}, keys, size).drop("_tr0")


def _runs_pass() -> Pass:
    """Over chunk ends, for both counts of the trend: what was counted since the last reset, and whether it was bumped, before each chunk."""

    def start() -> Callable:
        count, bumped = [0, 0], [0, 0]

        def step(*row: int) -> tuple:
            out = (*count, *bumped)
            for i in range(2):
                reset, n, bump = row[3 * i : 3 * i + 3]
                bumped[i] = bump if reset else int(bumped[i] or (count[i] == 0 and bump))
                count[i] = n if reset else count[i] + n
            return out

        return step

    return start, [f"_{x}_{n}" for n in ("hh", "ll") for x in ("reset", "end", "bump")], [(f"_{x}_{n}", T.LongType()) for x in ("came", "bumped") for n in ("hh", "ll")]


def _trend_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with hh_count and ll_count from the flags _up_* and _down_* of its swings (see add_trend_state)."""
    part = within(keys)
    so_far = part.rowsBetween(FIRST, 0)
    parts = (("hh", "_up_high", "_down_high", "_up_low"), ("ll", "_down_high", "_up_high", "_down_low"))
    df = df.withColumns({f"_sum_{n}": F.sum(count).over(so_far) for n, count, _, _ in parts})
    at = {n: F.last(F.when(F.col(reset) == 1, F.struct(F.col(f"_sum_{n}").alias("n"), F.col("bar_idx").alias("i"))), True).over(so_far) for n, _, reset, _ in parts}
    df = df.withColumns({f"_at_{n}": x for n, x in at.items()})
    df = df.withColumns({f"_n_{n}": F.col(f"_sum_{n}") - F.coalesce(F.col(f"_at_{n}.n"), F.lit(0)) for n, *_ in parts})
    df = df.withColumns({f"_b_{n}": F.max(F.when((F.col(bump) == 1) & (F.col(f"_n_{n}") == 0), F.col("bar_idx"))).over(so_far) for n, _, _, bump in parts})
    df = df.withColumns({f"_b_{n}": flag(F.col(f"_b_{n}") >= F.coalesce(F.col(f"_at_{n}.i"), F.lit(-1))) for n, *_ in parts})
    end = lambda x: F.max_by(x, "bar_idx")
    ends = [e for n, *_ in parts for e in (end(F.col(f"_at_{n}").isNotNull().cast("long")).alias(f"_reset_{n}"), end(F.col(f"_n_{n}").cast("long")).alias(f"_end_{n}"), end(F.col(f"_b_{n}").cast("long")).alias(f"_bump_{n}"))]
    table = df.groupBy(*keys, CHUNK).agg(*ends).withColumn(ORDER, F.col(CHUNK))
    came = scan(table, [_runs_pass()], keys).select(*keys, CHUNK, *(f"_{x}_{n}" for x in ("came", "bumped") for n in ("hh", "ll")))
    df = joined(df, came, [*keys, CHUNK])
    out = {}
    for n, *_ in parts:
        open_ = F.col(f"_at_{n}").isNull()
        count = F.col(f"_n_{n}") + F.when(open_, F.col(f"_came_{n}")).otherwise(0)
        bump = F.when(open_, F.greatest(F.col(f"_bumped_{n}"), F.when(F.col(f"_came_{n}") == 0, F.col(f"_b_{n}")).otherwise(0))).otherwise(F.col(f"_b_{n}"))
        out[f"{n}_count"] = (count + bump).cast("int")
    return df.withColumns(out).drop(*(f"_{x}_{n}" for x in ("sum", "at", "n", "b", "came", "bumped") for n, *_ in parts))


def add_structure_in_chunks(df: DataFrame, window: int = 3, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """The columns of add_swings, add_trend_state, add_bos and add_choch, one after the other, as by default; bar_idx stays."""
    df = ensure_atr_in_chunks(df, keys=keys, size=size)

    def swings(d: DataFrame, k: Sequence[str]) -> DataFrame:
        d = add_swings(d, window, keys=k)
        known = {f"_l_{s}": F.lag(f"swing_{s}_price", window).over(ordered(k)) for s, _ in SIDES} | {f"_i_{s}": F.lag(F.when(F.col(f"swing_{s}") == 1, F.col("bar_idx")), window).over(ordered(k)) for s, _ in SIDES}
        return d.withColumns(known).drop(*(c for s, _ in SIDES for c in (f"last_swing_{s}", f"last_swing_{s}_idx", f"swing_{s}_age")))

    df = stored(in_chunks(df, swings, 2 * window, window, keys, size), "swings")
    price = {s: F.col(f"swing_{s}_price") for s, _ in SIDES}
    last = {f"last_swing_{s}": Carry("last", F.col(f"_l_{s}")) for s, _ in SIDES} | {f"last_swing_{s}_idx": Carry("last", F.col(f"_i_{s}")) for s, _ in SIDES} | {f"_p_{s}": Carry("last", price[s], False) for s, _ in SIDES}
    df = carried(df, last, keys).withColumns({f"last_swing_{s}_idx": F.col(f"last_swing_{s}_idx").cast("double") for s, _ in SIDES})
    df = df.withColumns({f"swing_{s}_age": F.col("bar_idx") - F.col(f"last_swing_{s}_idx") for s, _ in SIDES})
    df = df.withColumns({f"_up_{s}": flag(price[s] > F.col(f"_p_{s}")) for s, _ in SIDES} | {f"_down_{s}": flag(price[s] < F.col(f"_p_{s}")) for s, _ in SIDES})
    level = {"bull": F.col("last_swing_high"), "bear": F.col("last_swing_low")}
    beyond = {"bull": F.col("close") > level["bull"], "bear": F.col("close") < level["bear"]}
    df = df.withColumns({f"_c_{k}": F.when(beyond[k] & (F.col("bar_idx") >= 1), level[k]) for k in level})
    df = stored(df.drop(*(f"_{x}_{s}" for x in "lip" for s, _ in SIDES)), "levels")

    df = _trend_counts(df, keys)
    df = carried(df, {f"_was_{k}": Carry("last", F.col(f"_c_{k}"), False) for k in level}, keys)
    df = df.withColumns({f"bos_{k}": flag(F.col(f"_c_{k}").isNotNull() & ~F.col(f"_c_{k}").eqNullSafe(F.col(f"_was_{k}"))) for k in level})
    df = stored(df.drop(*(f"_{x}_{k}" for x in ("c", "was") for k in level), *(f"_{x}_{s}" for x in ("up", "down") for s, _ in SIDES)), "breaks")

    bull, bear = F.col("bos_bull") == 1, F.col("bos_bear") == 1
    state = F.when(F.col("hh_count") >= 2, 1).when(F.col("ll_count") >= 2, -1)
    df = carried(df, {"trend_state": Carry("last", state), "_before": Carry("last", state, False), "bos_direction": Carry("last", F.when(bull, 1).when(bear, -1))}, keys)
    body = F.when(F.col("atr_14") > 0, F.abs(F.col("close") - F.col("open")) / F.col("atr_14"))
    turn = {"bull": (F.col("_before") == -1) & bull, "bear": (F.col("_before") == 1) & bear}
    return df.withColumns(
        {
            "trend_state": F.coalesce("trend_state", F.lit(0)), "bos_direction": F.coalesce("bos_direction", F.lit(0)), "bos_candle_body_atr": F.when(bull | bear, body),
            "bos_swing_age": F.when(bull, F.col("swing_high_age")).when(bear, F.col("swing_low_age")).cast("double"),
            "choch_bull": flag(turn["bull"]), "choch_bear": flag(turn["bear"]), "choch_candle_body_atr": F.when(turn["bull"] | turn["bear"], body),
        }
    ).drop("_before", CHUNK)
