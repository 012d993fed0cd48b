"""Averages, ATR, RSI, ADX, MACD and Bollinger bands.

The recursive ones asked for together run in one pass over each series (`smooth`); `add_*` each add one family.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import recurrence as rec
from ..functions.scan import Pass, dealt, scan
from ..functions.series import KEYS, flag, full, mean, ordered, ratio, rows

Task = tuple[Sequence[str], Sequence[str], Callable[[], Callable]]
"""Input columns, output columns, and what starts the step."""


def true_range(keys: Sequence[str] = KEYS, first_close: bool = False) -> Column:
    """The largest of high - low and the distances to the close before; on the first bar high - low, or with first_close its own close counts."""
    before = F.lag("close").over(ordered(keys))
    before = F.coalesce(before, F.col("close")) if first_close else before
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def smoothers(tasks: Sequence[Task]) -> Pass:
    """All tasks as one pass."""
    inputs = list(dict.fromkeys(c for i, _, _ in tasks for c in i))
    at = [[inputs.index(c) for c in i] for i, _, _ in tasks]
    starts = [s for _, _, s in tasks]

    def start() -> Callable:
        steps = [(s(), a) for s, a in zip(starts, at, strict=True)]

        def step(*row: float | None) -> tuple:
            out: list = []
            for f, a in steps:
                got = f(*(row[i] for i in a))
                out += got if isinstance(got, tuple) else (got,)
            return tuple(out)

        return step

    return start, inputs, [(o, T.DoubleType()) for _, out, _ in tasks for o in out]


def smooth(df: DataFrame, tasks: Sequence[Task], keys: Sequence[str] = KEYS, then: Sequence[Pass] = ()) -> DataFrame:
    """All tasks, and the passes that read them, in one go over each series. Helper inputs (_tr, _tr0, _change, _plus, _minus) are made as needed and go again."""
    w = ordered(keys)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    helpers = {
        "_tr": true_range(keys), "_tr0": true_range(keys, first_close=True), "_change": F.col("close") - F.lag("close").over(w),
        "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
    }
    all_ = smoothers(tasks)
    used = [c for c in all_[1] if c in helpers]
    df = df.withColumns({c: helpers[c].cast("double") for c in used}).withColumns({c: F.col(c).cast("double") for c in all_[1] if c not in used})
    return dealt(scan(df, [all_, *then], keys), keys).drop(*used)


def rank_pass(col: str, n: int, average: str | None = None, highest: str | None = None) -> Pass:
    """Rolling percentile rank of a column, by the average or the highest rank of ties."""
    chosen = [i for i, name in enumerate((average, highest)) if name]

    def start() -> Callable:
        step = rec.rolling_rank(n)
        return lambda x: tuple(step(x)[i] for i in chosen) if len(chosen) == 1 else step(x)

    return start, [col], [(name, T.DoubleType()) for name in (average, highest) if name]


def _or_length(fn: Callable) -> Callable:
    """fn that also takes its period by the name of length, which wins over period."""
    names = signature(fn)

    @wraps(fn)
    def run(*args: object, length: int | None = None, **kwargs: object) -> object:
        given = names.bind_partial(*args, **kwargs)
        if length is not None:
            given.arguments["period"] = length
        return fn(*given.args, **given.kwargs)

    return run


@_or_length
def ema_task(period: int, col: str = "close") -> Task:
    return (col,), (f"ema_{period}",), lambda: rec.ema(period)


@_or_length
def atr_task(period: int = 14) -> Task:
    return ("_tr",), (f"atr_{period}",), lambda: rec.rma(period)


@_or_length
def rsi_task(period: int = 14) -> Task:
    return ("_change",), (f"rsi_{period}",), lambda: rec.rsi(period)


@_or_length
def adx_task(period: int = 14) -> Task:
    return ("_tr", "_plus", "_minus"), (f"adx_{period}", f"dmp_{period}", f"dmn_{period}"), lambda: rec.adx(period)


def macd_task(fast: int = 12, slow: int = 26, signal: int = 9) -> Task:
    return ("close",), ("macd", "macd_signal", "macd_hist"), lambda: rec.macd(fast, slow, signal)


def ensure_atr(df: DataFrame, length: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with atr_14: the column it has, whatever its length, else the ATR whose warm-up is the mean true range so far."""
    if "atr_14" in df.columns:
        return df
    return smooth(df, [(("_tr0",), ("atr_14",), lambda: rec.expanding_rma(length))], keys)


def with_atr(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with atr_14: the column it has, else the ATR that is NULL during warm-up."""
    return df if "atr_14" in df.columns else smooth(df, [atr_task(14)], keys)


@_or_length
def compute_ema(df: DataFrame, period: int = 20, col: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    return smooth(df, [ema_task(period, col)], keys)


@_or_length
def sma(col: str, period: int = 20, keys: Sequence[str] = KEYS) -> Column:
    return mean(F.col(col), period, keys)


@_or_length
def bollinger(period: int = 20, std: float = 2.0, keys: Sequence[str] = KEYS) -> tuple[Column, Column, Column]:
    """Lower band, middle, upper band."""
    close = F.col("close")
    middle = mean(close, period, keys)
    wide = full(F.stddev_samp(close), close, period, -(period - 1), 0, keys) * std
    return middle - wide, middle, middle + wide


def emas(df: DataFrame, periods: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """The columns that follow from ema_P: slope over 3 bars in ATRs, price above it, and the crosses."""
    w = ordered(keys)
    out: dict[str, Column] = {}
    for p in periods:
        e = F.col(f"ema_{p}")
        out[f"ema_{p}_slope"] = ratio(e - F.lag(e, 3).over(w), F.col("atr_14"))
        out[f"price_above_ema_{p}"] = flag(F.col("close") > e)
    for a, b in ((20, 50), (50, 200)):
        if a in periods and b in periods:
            out[f"ema_{a}_above_{b}"] = flag(F.col(f"ema_{a}") > F.col(f"ema_{b}"))
    return df.withColumns(out)


def add_emas(df: DataFrame, periods: Sequence[int] = (20, 50, 200), keys: Sequence[str] = KEYS) -> DataFrame:
    return emas(smooth(df, [*([] if "atr_14" in df.columns else [atr_task()]), *(ema_task(p) for p in periods)], keys), periods, keys)


def adx_columns(df: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    a = F.col(f"adx_{period}")
    return df.withColumns({**{f"adx_above_{x}": flag(a > x) for x in (20, 25, 40)}, "adx_delta_3": a - F.lag(a, 3).over(ordered(keys))}).drop(f"dmp_{period}", f"dmn_{period}")


@_or_length
def add_adx(df: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    return adx_columns(smooth(df, [adx_task(period)], keys), period, keys)


def rsi_columns(df: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    r = F.col(f"rsi_{period}")
    return df.withColumns({"rsi_above_50": flag(r > 50), "rsi_above_70": flag(r > 70), "rsi_below_30": flag(r < 30), "rsi_delta_3": r - F.lag(r, 3).over(ordered(keys))})


@_or_length
def add_rsi(df: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    return rsi_columns(smooth(df, [rsi_task(period)], keys), period, keys)


def macd_columns(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    h = F.col("macd_hist")
    before = F.lag(h).over(ordered(keys))
    return df.withColumns({"macd_hist_positive": flag(h > 0), "macd_hist_expanding": flag(F.abs(h) > F.abs(before)), "macd_hist_delta": h - before}).drop("macd", "macd_signal")


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Sequence[str] = KEYS) -> DataFrame:
    return macd_columns(smooth(df, [macd_task(fast, slow, signal)], keys), keys)


@_or_length
def add_atr(df: DataFrame, period: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    return smooth(df, [atr_task(period)], keys, [rank_pass(f"atr_{period}", 50, "atr_pct_50")])


def _bb_width(df: DataFrame, period: int, std: float, keys: Sequence[str]) -> DataFrame:
    low, middle, high = bollinger(period, std, keys)
    return df.withColumn("bb_width", ratio(high - low, middle))


def _bb_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"bb_width_below_{x}": flag(F.col("bb_width_pct_50") < x) for x in (30, 40)})


@_or_length
def add_bb_width(df: DataFrame, period: int = 20, std: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    return _bb_flags(scan(_bb_width(df, period, std, keys), [rank_pass("bb_width", 50, "bb_width_pct_50")], keys))


def add_body_ratio(df: DataFrame) -> DataFrame:
    spread = F.col("high") - F.col("low")
    body = F.when(spread > 0, F.abs(F.col("close") - F.col("open")) / spread).otherwise(0.0)
    return df.withColumns({"body_ratio": body, "body_ratio_above_60": flag(body > 0.6)})


def add_rolling_atr_ratio(df: DataFrame, impulse_len: int = 5, pullback_len: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean ATR of the last pullback_len bars over that of the impulse_len before; missing values are left out of the means."""
    df = with_atr(df, keys)
    late = F.avg("atr_14").over(rows(-(pullback_len - 1), 0, keys))
    early = F.avg("atr_14").over(rows(-(pullback_len + impulse_len - 1), -pullback_len, keys))
    enough = F.row_number().over(ordered(keys)) >= impulse_len + pullback_len
    return df.withColumn("atr_ratio_rolling", F.when(enough, ratio(late, early)))


def compute_atr_ratio(df: DataFrame, impulse_start: int, impulse_end: int, pullback_start: int, pullback_end: int, atr_col: str = "atr_14", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series: mean ATR of bars [pullback_start, pullback_end) over that of [impulse_start, impulse_end). Needs bar_idx."""
    part = lambda a, b: F.avg(F.when((F.col("bar_idx") >= a) & (F.col("bar_idx") < b), F.col(atr_col)))
    return df.groupBy(*keys).agg(ratio(part(pullback_start, pullback_end), part(impulse_start, impulse_end)).alias("atr_ratio"))


def add_foundation(df: DataFrame, keys: Sequence[str] = KEYS, atr_rank: str | None = None) -> DataFrame:
    """ATR, EMAs, ADX, RSI, MACD, Bollinger width and body ratio; the recursive ones in one pass. atr_rank names a column for the ATR's highest rank."""
    periods = (20, 50, 200)
    tasks = [atr_task(), *(ema_task(p) for p in periods), adx_task(), rsi_task(), macd_task()]
    df = smooth(_bb_width(df, 20, 2.0, keys), tasks, keys, [rank_pass("atr_14", 50, "atr_pct_50", atr_rank), rank_pass("bb_width", 50, "bb_width_pct_50")])
    df = macd_columns(rsi_columns(adx_columns(emas(df, periods, keys), keys=keys), keys=keys), keys)
    return add_body_ratio(_bb_flags(df))
