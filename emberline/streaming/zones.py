"""Live gaps over a stream of bars, with typed state for each series and timers of event time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.resume import state_of
from ..functions.series import KEYS
from ..operators.zones import Zone, fvg_fill_pass

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
"""The state store that this kind of state needs: a setting of the session."""
_ZONE = "side string, lo double, hi double, confirm long, fill double"


class _Fill(StatefulProcessor):
    """Bars wait in a list until the watermark has passed them; a timer, set to the first that waits, then releases them in order, and the zones they leave alive are kept."""

    def __init__(self, keys: Sequence[str], inputs: Sequence[str], outputs: Sequence[str], kinds: dict[str, str], options: dict) -> None:
        self.keys, self.inputs, self.outputs, self.kinds, self.options = keys, inputs, outputs, kinds, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["at long", *(f"{c} {self.kinds[c]}" for c in self.inputs)]))
        self.zones = handle.getListState("zones", _ZONE)
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if at is not None and old <= at:
                return
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            bars = [(int(at), *(None if pd.isna(v) else v for v in values)) for at, *values in frame[["at_ms", *self.inputs]].itertuples(index=False) if at > final]
            if bars:
                self.waiting.appendList(bars)
                self._wake(min(b[0] for b in bars))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        bars = sorted((tuple(w) for w in self.waiting.get()), key=lambda b: b[0])
        due = [b for b in bars if b[0] <= now]
        if len(due) < len(bars):
            self._wake(bars[len(due)][0])
        if not due:
            return
        step = fvg_fill_pass(**self.options)[0]()
        live = state_of(step)["live"]
        for side, lo, hi, confirm, fill in self.zones.get():
            zone = Zone(lo, hi, confirm)
            zone.fill = fill
            live[side].append(zone)
        made = [step(*b[1:]) for b in due]
        self.waiting.put([b for b in bars if b[0] > now]) if len(due) < len(bars) else self.waiting.clear()
        left = [(s, z.lo, z.hi, z.confirm, float(z.fill)) for s, zones in live.items() for z in zones]
        self.zones.put(left) if left else self.zones.clear()
        out = pd.DataFrame(made, columns=list(self.outputs))
        out.insert(0, "timestamp", pd.to_datetime([b[0] for b in due], unit="ms"))
        for i, k in enumerate(self.keys):
            out.insert(i, k, key[i])
        yield out

    def close(self) -> None:
        pass


def stream_fvg_fill(bars: DataFrame, late: str = "1 hour", keys: Sequence[str] = KEYS, **options: object) -> DataFrame:
    """The columns of add_fvg_fill over a stream of bars with their gaps (columns as add_fvg makes them, bar_idx and atr_14), each bar once the watermark has passed it.

    Bars may come out of order by up to `late`; later ones are left out. State is a list of zones, as many as track_last_n says, and the bars that wait. The session must use
    the state store ROCKS. Times are kept in milliseconds.
    """
    _, inputs, outputs = fvg_fill_pass(**options)
    kinds = dict(bars.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "timestamp timestamp", *(f"{n} {t.simpleString()}" for n, t in outputs)])
    rows = bars.withWatermark("timestamp", late).withColumn("at_ms", F.unix_millis("timestamp"))
    processor = _Fill(keys, inputs, [n for n, _ in outputs], kinds, options)
    return rows.select(*keys, "timestamp", "at_ms", *inputs).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
