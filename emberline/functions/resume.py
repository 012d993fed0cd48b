"""Sequential passes that go on where an earlier run ended.

A step keeps what it knows in the variables it closes over, and in those of the steps it calls. Their values, without code, are a series' state: saved with a
version of the passes, and put into fresh steps by the next run. States are pickled, so read only tables of states that runs of one's own have written.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from types import FunctionType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .scan import Pass, dealt
from .series import KEYS, ORDER

STATE, TAIL = "_state", "_tail"


def _steps_in(value: object) -> bool:
    return isinstance(value, FunctionType) or (isinstance(value, (list, tuple)) and any(map(_steps_in, value)))


def state_of(value: object, seen: frozenset[int] = frozenset()) -> object:
    """The values that a step, or a list of steps, holds on to: a dict by name for a step."""
    if isinstance(value, FunctionType):
        if id(value) in seen:
            return None
        cells = zip(value.__code__.co_freevars, value.__closure__ or (), strict=True)
        return {n: state_of(c.cell_contents, seen | {id(value)}) for n, c in cells}
    return [state_of(v, seen) for v in value] if _steps_in(value) else value


def restore(value: object, state: object, seen: frozenset[int] = frozenset()) -> None:
    """Puts a state into a fresh step, or a list of steps, of the same kind."""
    if isinstance(value, FunctionType):
        if id(value) not in seen:
            for n, cell in zip(value.__code__.co_freevars, value.__closure__ or (), strict=True):
                if _steps_in(cell.cell_contents):
                    restore(cell.cell_contents, state[n], seen | {id(value)})
                else:
                    cell.cell_contents = state[n]
    elif _steps_in(value):
        for v, s in zip(value, state, strict=True):
            restore(v, s, seen)


def scan_on(df: DataFrame, passes: Sequence[Pass], saved: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of df with the passes' outputs, and for each series one row more that has its state in STATE and nulls in all but the keys.

    saved has the keys and STATE of an earlier run: its series go on from there, others begin. Rows with TAIL set are those that run has
    been through: they pass with the outputs they have.
    """
    made = {n: t for _, _, outputs in passes for n, t in outputs}
    df = df.withColumns({n: F.lit(None).cast(t) for n, t in made.items() if n not in df.columns} | ({} if TAIL in df.columns else {TAIL: F.lit(False)}))
    df = df.withColumn(STATE, F.lit(None).cast("binary"))
    if saved is not None:
        df = df.unionByName(saved.select(*keys, STATE), allowMissingColumns=True)
    schema = T.StructType([T.StructField(f.name, made.get(f.name, f.dataType)) for f in df.schema.fields])
    names = schema.fieldNames()
    arrow = {n: to_arrow_type(t) for n, t in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series: tuple | None = None
        steps: list[Callable] = []

        def last() -> pa.RecordBatch:
            state = dict(zip(keys, series, strict=True)) | {STATE: pickle.dumps(state_of(steps))}
            return pa.RecordBatch.from_arrays([pa.array([state.get(f.name)], f.type) for f in layout], names=names)

        for batch in batches:
            layout = batch.schema
            at = {n: i for i, n in enumerate(names)}
            columns = {c: batch.column(at[c]).to_pylist() for c in {*keys, STATE, TAIL, *made, *(c for _, inputs, _ in passes for c in inputs)}}
            kept = []
            for i, name in enumerate(zip(*(columns[k] for k in keys), strict=True)):
                if name != series:
                    if series is not None:
                        ended = last()
                        yield ended
                    series, steps = name, [start() for start, _, _ in passes]
                if columns[STATE][i] is not None:
                    restore(steps, pickle.loads(columns[STATE][i]))  # noqa: S301
                    continue
                kept.append(i)
                if not columns[TAIL][i]:
                    for step, (_, inputs, outputs) in zip(steps, passes, strict=True):
                        for (n, _), v in zip(outputs, step(*(columns[c][i] for c in inputs)), strict=True):
                            columns[n][i] = v
            full = [pa.array(columns[n], arrow[n]) if n in made else batch.column(at[n]) for n in names]
            yield pa.RecordBatch.from_arrays(full, names=names).take(pa.array(kept, pa.int64()))
        if series is not None:
            yield last()

    return dealt(df, keys).sortWithinPartitions(*keys, F.col(STATE).isNull(), ORDER).mapInArrow(run, schema)
