"""Series cut into chunks of bars, so that one series is the work of many tasks.

A chunk is a run of `size` bars of a series. What a bounded frame can say is computed chunk by chunk, each with copies of the bars before and after
it that frames reach (`in_chunks`). What is carried without bound - the last value, sums, smoothed averages - is computed within chunks and completed from
a small table of the chunks' ends, one row a chunk (`carried`, `smoothed`). No task holds a series, only the ends of one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scan import Pass, dealt, scan
from .series import FIRST, KEYS, LAST, ORDER
from .shared import stored

CHUNK, OWN = "_chunk", "_own"
SIZE = 512
"""Bars of a chunk: few enough that a power of any smoother's weight stays a double, many enough that halos and ends are a small part."""


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which nulls are equal, as they are in groups."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return left.join(right, same, how).drop(*(f"_r_{c}" for c in on))


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """df with bar_idx, the bar's number in its series from 0, and its chunk.

    Bars are numbered within slices of time, of about `size` bars each if a series is spread evenly, after the sums of the slices before.
    """
    if "bar_idx" not in df.columns:
        at = F.unix_micros(ORDER)
        spans = df.groupBy(*keys).agg(F.min(at).alias("_from"), (F.max(at) - F.min(at) + 1).alias("_span"), F.ceil(F.count("*") / size).alias("_slices"))
        sliced = joined(df, spans, keys).withColumn("_slice", F.floor((at - F.col("_from")) / F.col("_span") * F.col("_slices"))).drop("_from", "_span", "_slices")
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(FIRST, -1)
        begins = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_in")).withColumn("_begin", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
        place = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(ORDER)) - 1
        df = joined(sliced.withColumn("_place", place), begins, [*keys, "_slice"])
        df = df.withColumn("bar_idx", (F.col("_begin") + F.col("_place")).cast("int")).drop("_slice", "_begin", "_place")
    return df.withColumn(CHUNK, F.floor(F.col("bar_idx") / size).cast("int"))


def with_halo(df: DataFrame, back: int, ahead: int, size: int = SIZE) -> DataFrame:
    """df with each bar in its chunk (OWN is true) and copies in the chunks whose bars reach `back` bars back or `ahead` bars ahead to it."""
    first = F.greatest(F.lit(0), F.floor((F.col("bar_idx") - ahead) / size).cast("int"))
    last = F.floor((F.col("bar_idx") + back) / size).cast("int")
    rows = df.withColumn("_at", F.col(CHUNK)).withColumn(CHUNK, F.explode(F.sequence(first, last)))
    return rows.withColumn(OWN, F.col("_at") == F.col(CHUNK)).drop("_at")


def in_chunks(df: DataFrame, operator: Callable[[DataFrame, Sequence[str]], DataFrame], back: int, ahead: int = 0, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """operator(df, keys) chunk by chunk: right for columns that depend on at most `back` bars before and `ahead` bars after their own. Keeps bar_idx and the chunk."""
    rows = operator(dealt(with_halo(numbered(df, keys, size), back, ahead, size), (*keys, CHUNK)), (*keys, CHUNK))
    return rows.where(OWN).drop(OWN)


def within(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy("bar_idx")


@dataclass(frozen=True)
class Carry:
    """A value carried along a series: the last that is not null, the sum or the greatest of `of` up to a bar, or up to the bar before."""

    kind: str
    of: Column
    inclusive: bool = True


def carried(df: DataFrame, columns: dict[str, Carry], keys: Sequence[str] = KEYS) -> DataFrame:
    """df (with bar_idx and chunk, best a stored table as it is read twice) with the carried columns."""
    df = df.withColumns({f"_v_{n}": c.of for n, c in columns.items()})
    inside, ends, before, out = {}, {}, {}, {}
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(FIRST, -1)
    for n, c in columns.items():
        value, here, at_end, came = F.col(f"_v_{n}"), F.col(f"_h_{n}"), F.col(f"_e_{n}"), F.col(f"_c_{n}")
        frame = within(keys).rowsBetween(FIRST, 0 if c.inclusive else -1)
        inside[f"_h_{n}"] = F.last(value, True).over(frame) if c.kind == "last" else (F.sum if c.kind == "sum" else F.max)(value).over(frame)
        ends[f"_e_{n}"] = F.max_by(value, F.when(value.isNotNull(), F.col("bar_idx"))) if c.kind == "last" else (F.sum if c.kind == "sum" else F.max)(value)
        before[f"_c_{n}"] = F.last(at_end, True).over(earlier) if c.kind == "last" else (F.sum if c.kind == "sum" else F.max)(at_end).over(earlier)
        out[n] = F.coalesce(here, came) if c.kind == "last" else F.coalesce(here, F.lit(0)) + F.coalesce(came, F.lit(0)) if c.kind == "sum" else F.greatest(here, came)
    table = df.groupBy(*keys, CHUNK).agg(*(e.alias(n) for n, e in ends.items())).withColumns(before).drop(*ends)
    rows = joined(df.withColumns(inside), table, [*keys, CHUNK]).withColumns(out)
    return rows.drop(*(f"_{x}_{n}" for x in "vhc" for n in columns))


@dataclass(frozen=True)
class Smoother:
    """y = keep * y before + gain * x at each x that is not null; other bars repeat y.

    The warm-th value starts it, with the mean or sum of the values among the last `warm` bars; before, y is null. With early, y is the mean of the values so far up to there.
    level is what y stays at while x stays at 1.
    """

    of: str
    keep: float
    gain: float
    warm: int
    start: str = "mean"
    early: bool = False
    level: float = 1.0


def ema(of: str, period: int) -> Smoother:
    """Weight 2 / (period + 1), from the first value on."""
    return Smoother(of, (period - 1) / (period + 1), 2 / (period + 1), 1)


def rma(of: str, period: int, early: bool = False) -> Smoother:
    """Wilder's average."""
    return Smoother(of, 1 - 1 / period, 1 / period, period, early=early)


def wilder_sum(of: str, period: int) -> Smoother:
    return Smoother(of, 1 - 1 / period, 1.0, period, "sum", level=float(period))


def _ends_pass(counts: Sequence[str], totals: Sequence[str], smoothers: dict[str, Smoother]) -> Pass:
    """A chunk's row takes what came before it: counts and sums of values, and what each recurrence would have had it started from 0 at the series' first bar."""
    steps = [(s.keep, s.level, counts.index(s.of)) for s in smoothers.values()]

    def start() -> Callable:
        seen, sums, came = [0] * len(counts), [0.0] * len(totals), [0.0] * len(steps)

        def step(*row: float) -> tuple:
            nonlocal seen, sums, came
            n, origin, t, ends = row[: len(counts)], row[len(counts) : 2 * len(counts)], row[2 * len(counts) : 2 * len(counts) + len(totals)], row[2 * len(counts) + len(totals) :]
            out = (*seen, *sums, *came)
            came = [level * origin[i] + keep ** n[i] * (c - level * origin[i] + e) if n[i] else c for (keep, level, i), c, e in zip(steps, came, ends, strict=True)]
            seen = [a + b for a, b in zip(seen, n, strict=True)]
            sums = [a + (b or 0.0) for a, b in zip(sums, t, strict=True)]
            return out

        return step

    outputs = [*((f"_seen_{c}", T.LongType()) for c in counts), *((f"_sum_{c}", T.DoubleType()) for c in totals), *((f"_came_{n}", T.DoubleType()) for n in smoothers)]
    return start, [*(f"_n_{c}" for c in counts), *(f"_o_{c}" for c in counts), *(f"_t_{c}" for c in totals), *(f"_e_{n}" for n in smoothers)], outputs


def smoothed(df: DataFrame, smoothers: dict[str, Smoother], keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """df (with bar_idx and chunk, best a stored table as it is read three times) with a column for each smoother.

    Within a chunk, after u values, the recurrence from 0 is keep^u times the sum of gain * x * keep^-u, a running sum. A chunk hands on keep^n and what it
    ends with; these pairs compose, so a pass over the table of chunk ends gives each chunk what came before. The recurrence from 0 and the
    one from its start differ by keep^count * c at each bar, and the starting bar tells c.
    Sums and what came are taken from the chunk's value nearest 0 on: the digits lost are those of distances within a chunk, which for prices are far smaller
    than the prices, and no distance is over twice its value.
    """
    if short := [n for n, s in smoothers.items() if s.keep <= 0]:
        raise ValueError(f"periods must be over 1: {short}")
    counts = list(dict.fromkeys(s.of for s in smoothers.values()))
    totals = list(dict.fromkeys(s.of for s in smoothers.values() if s.early))
    halo = max(s.warm for s in smoothers.values()) - 1
    part = within(keys)
    so_far = part.rowsBetween(FIRST, 0)

    def inside(chunks: DataFrame | None = None) -> DataFrame:
        rows = with_halo(df, halo, 0, size)
        if chunks is not None:
            rows = joined(rows, chunks.select(*keys, CHUNK), [*keys, CHUNK], "left_semi")
        own = {c: F.when(F.col(OWN), F.col(c).cast("double")) for c in counts}
        rows = rows.withColumns({f"_u_{c}": F.count(x).over(so_far) for c, x in own.items()} | {f"_o_{c}": F.min_by(x, F.abs(x)).over(part.rowsBetween(FIRST, LAST)) for c, x in own.items()})
        out = {f"_t_{c}": F.sum(own[c]).over(so_far) for c in totals}
        for n, s in smoothers.items():
            out[f"_z_{n}"] = F.coalesce(F.sum((own[s.of] - F.col(f"_o_{s.of}")) * s.gain * F.pow(F.lit(s.keep), -F.col(f"_u_{s.of}"))).over(so_far), F.lit(0.0))
            out[f"_f_{n}"] = (F.sum if s.start == "sum" else F.avg)(F.col(s.of).cast("double")).over(part.rowsBetween(-(s.warm - 1), 0))
        return rows.withColumns(out).where(OWN).drop(OWN)

    ends = [*(F.max(f"_u_{c}").alias(f"_n_{c}") for c in counts), *(F.first(f"_o_{c}").alias(f"_o_{c}") for c in counts), *(F.max_by(f"_t_{c}", "bar_idx").alias(f"_t_{c}") for c in totals), *(F.max_by(f"_z_{n}", "bar_idx").alias(f"_e_{n}") for n in smoothers)]
    table = inside().groupBy(*keys, CHUNK).agg(*ends).withColumn(ORDER, F.col(CHUNK))
    made = [*(f"_seen_{c}" for c in counts), *(f"_sum_{c}" for c in totals), *(f"_came_{n}" for n in smoothers)]
    came = stored(scan(table, [_ends_pass(counts, totals, smoothers)], keys).select(*keys, CHUNK, *made), "ends")

    count = lambda s: F.col(f"_seen_{s.of}") + F.col(f"_u_{s.of}")
    power = lambda s, of, sign=1: F.pow(F.lit(s.keep), sign * F.col(f"_{of}_{s.of}"))
    origin = lambda s: F.coalesce(F.col(f"_o_{s.of}"), F.lit(0.0)) * s.level
    # Only a chunk that begins before a smoother has started can hold its start.
    heads = came.where(reduce(lambda a, b: a | b, (F.col(f"_seen_{s.of}") < s.warm for s in smoothers.values())))
    mean = lambda s: (F.col(f"_sum_{s.of}") + F.coalesce(F.col(f"_t_{s.of}"), F.lit(0.0))) / count(s)
    first = {n: mean(s) if s.early else F.col(f"_f_{n}") for n, s in smoothers.items()}
    starts = {n: (count(s) == s.warm) & F.col(s.of).isNotNull() for n, s in smoothers.items()}
    constant = lambda n, s: ((first[n] - origin(s)) * power(s, "u", -1) - F.col(f"_z_{n}") + origin(s) - F.col(f"_came_{n}")) * power(s, "seen", -1)
    begins = [F.max(F.when(starts[n], constant(n, s))).alias(f"_c_{n}") for n, s in smoothers.items()] + [F.max(F.when(starts[n], first[n])).alias(f"_b_{n}") for n in smoothers]
    constants = joined(inside(heads), heads, [*keys, CHUNK]).groupBy(*keys).agg(*begins)

    out = {}
    for n, s in smoothers.items():
        came_in = F.col(f"_came_{n}") + power(s, "seen") * F.col(f"_c_{n}")
        y = F.when(count(s) == s.warm, F.col(f"_b_{n}")).when(count(s) > s.warm, origin(s) + power(s, "u") * (came_in - origin(s) + F.col(f"_z_{n}")))
        out[n] = F.coalesce(y, F.when(count(s) > 0, mean(s))) if s.early else y
    rows = joined(joined(inside(), came, [*keys, CHUNK]), constants, keys).withColumns(out)
    return rows.drop(*made, *(f"_{x}_{c}" for x in "uo" for c in counts), *(f"_t_{c}" for c in totals), *(f"_{x}_{n}" for x in "zfcb" for n in smoothers))
