"""Ordered patterns of events: a start, then one event after the other, each within its time of the one before.

All stages' events go into one order by time, and one automaton walks it with the matches begun so far. A match waits for its next stage; it takes the first
event that fits and ends when its time is over, so the automaton holds no more than the starts of the longest time limit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Pass, scan
from .series import ORDER


@dataclass(frozen=True)
class Stage:
    """rows have the keys, `at` (when the event is known, or where it is the last stage, when its bar begins), `side` (1 or -1), and as needed `low`, `high` and `close`.

    within: seconds since the stage before. zone: the event's range, low to high, must reach into the first stage's. closes: its close must be beyond that range, above
    it for side 1. An event fits only matches of its side.
    """

    name: str
    rows: DataFrame
    within: int = 0
    zone: bool = False
    closes: bool = False


_VALUES = ("low", "high", "close")


def _automaton(limits: Sequence[int], zones: Sequence[bool], closes: Sequence[bool]) -> Pass:
    """Each row is one event; it gives, for each match that it begins or moves on, the match's number and the times of its stages so far."""
    last = len(limits) - 1

    def start() -> Callable:
        begun: list[tuple] = []
        count = 0

        def fits(waits: int, lo: float | None, hi: float | None, side: int, low: float | None, high: float | None, close: float | None) -> bool:
            if (zones[waits] or closes[waits]) and (lo is None or hi is None):
                return False
            if zones[waits] and (low is None or high is None or low > hi or high < lo):
                return False
            return not closes[waits] or (close is not None and (close > hi if side == 1 else close < lo))

        def step(stage: int, at: int, side: int, low: float | None, high: float | None, close: float | None) -> tuple:
            nonlocal begun, count
            still, moved = [], []
            for match in begun:
                number, times, its_side, lo, hi = match
                waits = len(times)
                if at - times[-1] > limits[waits]:
                    continue
                if waits == stage and its_side == side and fits(waits, lo, hi, side, low, high, close):
                    match = (number, (*times, at), side, lo, hi)
                    moved.append([number, *times, at])
                    if stage == last:
                        continue
                still.append(match)
            begun = still
            if stage == 0:
                count += 1
                moved.append([count, at])
                if last:
                    begun.append((count, (at,), side, low, high))
            return (moved,)

        return step

    return start, ["_stage", "_at", "side", *_VALUES], [("_moved", T.ArrayType(T.ArrayType(T.LongType())))]


def matches(stages: Sequence[Stage], keys: Sequence[str] = ("instrument",)) -> DataFrame:
    """keys, side, the first stage's low and high, and the time of each stage (`<name>_at`), NULL from the first that does not follow on; one row for each start, alike ones being one.

    Events of one time come in the order of the stages, so a stage may follow at the time of the one before. A series is one task, but its rows are events, not bars.
    """
    parts = []
    for n, s in enumerate(stages):
        columns = [F.unix_timestamp("at").alias("_at"), F.lit(n).alias("_stage"), F.col("side").cast("int").alias("side"), *(F.col(c).cast("double").alias(c) if c in s.rows.columns else F.lit(None).cast("double").alias(c) for c in _VALUES)]
        parts.append(s.rows.select(*keys, *columns).where("_at IS NOT NULL AND side IS NOT NULL").distinct())
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn(ORDER, F.struct("_at", "_stage", "side", *_VALUES))
    found = scan(rows, [_automaton([s.within for s in stages], [s.zone for s in stages], [s.closes for s in stages])], keys)
    found = found.select(*keys, "side", F.when(F.col("_stage") == 0, F.struct("low", "high")).alias("_zone"), F.explode("_moved").alias("_m"))
    each = found.groupBy(*keys, F.col("_m")[0].alias("_n")).agg(F.first("side").alias("side"), F.max("_zone").alias("_zone"), F.max_by("_m", F.size("_m")).alias("_m"))
    return each.select(*keys, "side", "_zone.low", "_zone.high", *(F.timestamp_seconds(F.get("_m", F.lit(n + 1))).alias(f"{s.name}_at") for n, s in enumerate(stages)))
