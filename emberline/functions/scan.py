"""Sequential passes over series: what feeds back on itself and no window frame can express.

The table is dealt by series, each task sorts its rows, and a kernel walks the Arrow batches in order. A series' state is a few numbers
that live from row to row, so memory does not grow with its length. Series are the unit of parallelism.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .series import KEYS, ORDER

Step = Callable[..., tuple]
"""Takes a row's inputs, returns its outputs."""

Pass = tuple[Callable[[], Step], Sequence[str], Sequence[tuple[str, T.DataType]]]
"""What starts a series' step, the columns it reads, and the columns it makes."""


def dealt(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with each series in one partition, of as many as the session shuffles into.

    The number is given, so small series are not put together by size: it is their rows' work that counts. Windows over the keys that follow need
    no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scan(df: DataFrame, passes: Sequence[Pass], keys: Sequence[str] = KEYS) -> DataFrame:
    """df with the outputs of the passes over the rows of each series in order; outputs replace columns of their names.

    Passes run one after the other within a batch, and later ones may read what earlier ones made: several passes cost one shuffle and one
    way through Python.
    """
    made = {n: t for _, _, outputs in passes for n, t in outputs}
    keep = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType(keep + [T.StructField(n, t) for n, t in made.items()])
    arrow = {n: to_arrow_type(t) for n, t in made.items()}
    # What a pass reads from those before it.
    earlier = [{n for _, _, outputs in passes[:k] for n, _ in outputs} for k in range(len(passes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series: tuple | None = None
        steps: list[Step] = []
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            columns: dict[str, list] = {}
            fresh: dict[str, list] = {n: [] for n in made}

            def values(name: str) -> list:
                if name not in columns:
                    columns[name] = batch.column(at[name]).to_pylist()  # noqa: B023
                return columns[name]  # noqa: B023

            names = list(zip(*(values(k) for k in keys), strict=True))
            cuts = [i for i in range(len(names)) if names[i] != (names[i - 1] if i else series)] + [len(names)]
            begin = 0
            runs = []
            for cut in cuts:
                runs.append((begin, cut))
                begin = cut
            for a, b in runs:
                if a < b and names[a] != series:
                    series, steps = names[a], [start() for start, _, _ in passes]
                for k, (_, inputs, outputs) in enumerate(passes):
                    rows = zip(*((fresh[c] if c in earlier[k] else values(c))[a:b] for c in inputs), strict=True)
                    got = [steps[k](*row) for row in rows]
                    for n, made_ in zip((n for n, _ in outputs), zip(*got, strict=True) if got else ([] for _ in outputs), strict=True):
                        fresh[n] += made_
            arrays = [batch.column(at[f.name]) for f in keep] + [pa.array(fresh[n], t) for n, t in arrow.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return dealt(df, keys).sortWithinPartitions(*keys, ORDER).mapInArrow(run, schema)
