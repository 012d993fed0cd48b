"""A stored, enriched candle table that grows by runs: each goes on from the states of the last one and reads only the end of what is stored.

    path/rows/run=N     the bars of run N with all columns
    path/state/run=N    one row a series: the passes' state, the number of bars, the last bar's time and that from which a run needs the stored bars

A run counts when its state is written; before, it is as if it had not been, and the next one writes over it. So a run that broke off is repeated, and
bars that are stored already are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.resume import STATE, TAIL, scan_on
from ..functions.scan import Pass
from ..functions.series import KEYS, ORDER, flag, ordered, ratio
from ..functions.shared import stored
from ..operators import foundation as fd

Layer = Callable[[DataFrame, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Stack:
    """Columns without look-ahead: windows over bars, passes that read those, and windows over both. look_back: bars before its own that a window's frame reaches."""

    before: Layer
    passes: Sequence[Pass]
    after: Layer
    look_back: int
    helpers: tuple[str, ...] = ()

    def version(self) -> str:
        """Changes with the passes' inputs and outputs and with look_back; states of another version are refused."""
        return hashlib.sha256(repr((self.look_back, [(list(i), [n for n, _ in o]) for _, i, o in self.passes])).encode()).hexdigest()[:16]


def _before(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    df = df.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")})
    w = ordered(keys)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    low, middle, high = fd.bollinger(keys=keys)
    return df.withColumns({
        "_tr": fd.true_range(keys), "_change": F.col("close") - F.lag("close").over(w), "bb_width": ratio(high - low, middle),
        "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })


def _after(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    df = fd.macd_columns(fd.rsi_columns(fd.adx_columns(fd.emas(df, (20, 50, 200), keys), keys=keys), keys=keys), keys)
    df = df.withColumns({f"bb_width_below_{x}": flag(F.col("bb_width_pct_50") < x) for x in (30, 40)})
    df = op.add_vsa(op.add_candle_delta_proxy(op.add_key_volume_flags(op.add_volume_ratio(op.add_body_ratio(df), keys=keys), keys=keys), keys), keys)
    return op.add_rolling_atr_ratio(op.add_displacement_candle(op.add_wick_ratio(df), keys=keys), keys=keys)


_SMOOTHERS = fd.smoothers([fd.atr_task(), *(fd.ema_task(p) for p in (20, 50, 200)), fd.adx_task(), fd.rsi_task(), fd.macd_task()])
LIVE = Stack(_before, (_SMOOTHERS, fd.rank_pass("atr_14", 50, "atr_pct_50"), fd.rank_pass("bb_width", 50, "bb_width_pct_50")), _after, 20, ("_tr", "_change", "_plus", "_minus"))
"""ATR, EMAs, ADX, RSI, MACD and Bollinger width with ranks, volume and candle shape, and the rolling ATR ratio."""


def _states(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[DataFrame | None, int]:
    """Each series' newest state, and the number of the last run that counts (0 if none)."""
    try:
        states = spark.read.parquet(f"{path}/state")
        last = states.agg(F.max("run")).first()[0]
    except AnalysisException:
        return None, 0
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("run")))
    return states.withColumn("_n", newest).where("_n = 1").drop("_n"), int(last or 0)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs that count."""
    _, last = _states(spark, path, KEYS)
    return spark.read.parquet(f"{path}/rows").where(F.col("run") <= last)


def tail_of(spark: SparkSession, path: str, last: int, needed: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The stored rows from `_needed` on of each of its series. The least of these times is a condition of the scan; None without series."""
    since = needed.agg(F.min("_needed")).first()[0]
    if since is None:
        return None
    rows = spark.read.parquet(f"{path}/rows").where((F.col("run") <= last) & (F.col(ORDER) >= F.lit(since)))
    return rows.join(needed, list(keys)).where(F.col(ORDER) >= F.col("_needed")).drop("_needed", "run").withColumn(TAIL, F.lit(True))


def extend(bars: DataFrame, path: str, stack: Stack = LIVE, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds those of bars that come after each series' last stored one, and returns the rows added, with all columns.

    Of the stored rows it reads look_back bars a series, by a filter on time that reaches the scan. A ValueError tells of states that other passes made.
    """
    spark = bars.sparkSession
    states, last = _states(spark, path, keys)
    run = last + 1
    rows = bars.withColumn(TAIL, F.lit(False))
    if states is not None:
        if states.where(F.col("version") != stack.version()).limit(1).count():
            raise ValueError("stored states are of another version of the passes: build the table anew")
        ends = states.select(*keys, F.col("bars").alias("_bars"), F.col("last").alias("_last"), F.col("needed_from").alias("_needed"))
        rows = rows.join(ends, list(keys), "left").where(F.col("_last").isNull() | (F.col(ORDER) > F.col("_last"))).drop("_last", "_needed")
        rows = rows.withColumn("bar_idx", (F.coalesce("_bars", F.lit(0)) + F.row_number().over(ordered(keys)) - 1).cast("int")).drop("_bars")
        # Only series that go on need their ends, and the least time of those bounds what is read.
        going_on = rows.select(*keys).distinct().join(ends, list(keys))
        if (tail := tail_of(spark, path, last, going_on.select(*keys, "_needed"), keys)) is not None:
            rows = tail.unionByName(rows, allowMissingColumns=True)
        states = states.join(going_on.select(*keys), list(keys))
    else:
        rows = rows.withColumn("bar_idx", (F.row_number().over(ordered(keys)) - 1).cast("int"))
    out = scan_on(stack.before(rows, keys), stack.passes, states, keys)
    out = stored(out, "run")
    through = out.where(F.col(STATE).isNull()).drop(STATE)
    done = stack.after(through, keys).where(~F.col(TAIL)).drop(TAIL, *stack.helpers)
    done.write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    at_end = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ORDER)))
    ends = through.select(*keys, ORDER, "bar_idx").withColumn("_n", at_end).where(F.col("_n") <= stack.look_back)
    ends = ends.groupBy(*keys).agg(F.max(ORDER).alias("last"), F.min(ORDER).alias("needed_from"), (F.max("bar_idx") + 1).cast("long").alias("bars"))
    new = out.where(F.col(STATE).isNotNull()).select(*keys, STATE).join(ends, list(keys)).withColumn("version", F.lit(stack.version()))
    new.write.mode("overwrite").parquet(f"{path}/state/run={run}")
    return spark.read.parquet(f"{path}/rows/run={run}")
