import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from emberline import operators as op
from emberline.functions.chunks import CHUNK, Carry, carried, in_chunks, numbered, rma, smoothed, with_halo
from emberline.functions.series import with_bar_index
from emberline.functions.shared import stored
from emberline.operators import chunked
from emberline.plans import catalog

from .helpers import candles, walk

SIZE = 23


@pytest.fixture(scope="module")
def series(spark):
    """Two series of different lengths, one with gaps in time and flat stretches."""
    rng = random.Random(11)
    first = candles(spark, walk(rng, 260))
    flat = [(100, 100, 100, 100, 5)] * 12
    second = candles(spark, walk(rng, 60) + flat + walk(rng, 75), "Y").withColumn("timestamp", F.when(F.minute("timestamp") == 0, F.col("timestamp") + F.expr("interval 3 days") * F.floor(F.hour("timestamp") / 20)))
    return first.unionByName(second.dropDuplicates(["timestamp"])).repartition(5).cache()


def rows(df, columns):
    return [tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.orderBy("instrument", "timestamp").select("instrument", "bar_idx", *columns).collect()]


def same(a, b, columns):
    x, y = rows(a, columns), rows(b, columns)
    assert len(x) == len(y)
    for c, *pairs in zip(columns, *([*zip(p, q, strict=True)][2:] for p, q in zip(x, y, strict=True)), strict=True):
        wrong = [(x[i][:2], p) for i, p in enumerate(pairs) if p[0] != p[1] and not (isinstance(p[0], float) and p[1] is not None and abs(p[0] - p[1]) < 2e-6)]
        assert not wrong, (c, wrong[:3])


def test_numbers_and_halos(series):
    got = numbered(series, size=SIZE)
    assert rows(got, []) == rows(with_bar_index(series), [])
    assert {r[CHUNK] for r in got.where("instrument = 'X'").collect()} == set(range(12))
    halo = with_halo(got, 5, 2, SIZE).where(f"instrument = 'X' and {CHUNK} = 3")
    assert sorted(r.bar_idx for r in halo.collect()) == list(range(3 * SIZE - 5, 4 * SIZE + 2))
    assert halo.where("_own").count() == SIZE


def test_bounded_operators_over_chunk_borders(series):
    """Each operator of bounded frames, cut into chunks, gives the columns of the whole series."""
    base = op.ensure_atr(with_bar_index(series))
    cases = [
        (lambda d, k: op.add_volume_ratio(d, keys=k), 20, 0), (lambda d, k: op.add_vsa(d, k), 20, 0), (lambda d, k: op.add_rolling_atr_ratio(d, keys=k), 10, 0),
        (lambda d, k: op.pivots(d, keys=k), 2, 2), (lambda d, k: op.add_candle_delta_proxy(d, k), 20, 0), (lambda d, k: op.add_displacement_candle(d, keys=k), 0, 0),
    ]
    for operator, back, ahead in cases:
        whole = operator(base, ("instrument", "timeframe"))
        new = [c for c in whole.columns if c not in base.columns]
        same(whole, in_chunks(base, operator, back, ahead, size=SIZE), new)
        plan = in_chunks(base, operator, back, ahead, size=SIZE)._jdf.queryExecution().toString()
        assert CHUNK in plan


def test_every_operator_with_a_bound_can_be_cut(series):
    """The catalog's claim, held against whole series: what an operator makes in chunks of a few bars is what it makes of the series."""
    base = op.add_choch(op.add_bos(op.add_trend_state(op.add_swings(op.add_foundation(with_bar_index(series))))))
    base = stored(base.drop("bb_width", "bb_width_pct_50", "body_ratio", "body_ratio_above_60").withColumn("bb_width_below_40", F.lit(1)), "base")
    names = [n for n, e in catalog.CATALOG.items() if e.look_back is not None]
    assert len(names) >= 13
    for name in names:
        operator = catalog.CATALOG[name].operator
        given = base.drop(*(f"bb_width_below_{x}" for x in (30, 40))) if name == "bb_width" else base
        whole = operator(given)
        same(whole, catalog.cut(given, name, size=SIZE), [c for c in whole.columns if c not in given.columns])
    with pytest.raises(ValueError):
        catalog.cut(base, "bos")


def test_carried(series):
    df = numbered(series, size=SIZE).withColumn("v", F.when(F.col("close") % 3 == 0, F.col("close")))
    got = carried(df, {"a": Carry("last", F.col("v")), "b": Carry("last", F.col("v"), False), "c": Carry("sum", F.col("volume")), "d": Carry("max", F.col("v"), False)})
    for name in ("X", "Y"):
        last = top = None
        total = 0
        for r in got.where(F.col("instrument") == name).orderBy("bar_idx").collect():
            assert r.b == last and r.d == top
            last, total = r.v if r.v is not None else last, total + r.volume
            top = r.v if top is None else max(top, r.v) if r.v is not None else top
            assert r.a == last and r.c == total


def test_smoothers_with_missing_values(series):
    """Nulls anywhere, before the start and across chunk borders too, against the row by row steps."""
    from emberline.functions import recurrence as rec
    from emberline.functions.chunks import ema, wilder_sum

    df = numbered(series, size=SIZE).withColumn("x", F.when((F.col("bar_idx") > 4) & (F.pmod(F.xxhash64("timestamp"), F.lit(3)) > 0), F.col("close")))
    made = {"a": (ema("x", 9), lambda: rec.ema(9)), "b": (rma("x", 14), lambda: rec.rma(14)), "c": (wilder_sum("x", 7), lambda: rec.wilder_sum(7)), "d": (rma("x", 30, early=True), lambda: rec.expanding_rma(30)), "e": (rma("x", 2), lambda: rec.rma(2))}
    got = smoothed(df, {n: s for n, (s, _) in made.items()}, size=SIZE)
    for name in ("X", "Y"):
        steps = {n: start() for n, (_, start) in made.items()}
        for r in got.where(F.col("instrument") == name).orderBy("bar_idx").collect():
            for n, step in steps.items():
                want = step(r.x)
                assert r[n] == (None if want is None else pytest.approx(want, rel=1e-9)), (n, r.bar_idx)
    assert smoothed(df.where("false"), {"a": ema("x", 9)}, size=SIZE).count() == 0
    with pytest.raises(ValueError):
        smoothed(df, {"a": ema("x", 1)})


def test_smoothers_of_prices_are_right_to_their_last_digits(spark):
    """Against decimals of 50 digits, over three chunks of the usual size: prices in the thousands that move by cents, one of them a spike, then a flat stretch.

    Slopes are differences over three bars, so these are held too.
    """
    from emberline.functions.chunks import ema, wilder_sum

    rng, closes = random.Random(6), [2000.0]
    for _ in range(1299):
        closes.append(round(closes[-1] + rng.randint(-300, 300) / 100, 2))
    closes[700] = 9e5
    df = numbered(candles(spark, [(x, x, x, x) for x in closes] + [(1987.3,) * 4] * 40))
    got = smoothed(df, {"a": ema("close", 200), "b": ema("close", 20), "c": rma("close", 14), "d": wilder_sum("close", 14)}).orderBy("bar_idx").collect()
    with localcontext(prec=50):
        for name, weight, warm, level in (("a", Decimal(2) / 201, 1, 1), ("b", Decimal(2) / 21, 1, 1), ("c", Decimal(1) / 14, 14, 1), ("d", Decimal(1) / 14, 14, 14)):
            x = [Decimal(r.close) for r in got]
            want = [sum(x[:warm]) * level / warm]
            for v in x[warm:]:
                want.append(want[-1] + (v * level - want[-1]) * weight)
            off = [Decimal(r[name]) - w for r, w in zip(got[warm - 1 :], want, strict=True)]
            before = off[: 701 - warm]
            assert max(abs(o) for o in before) < level * Decimal("1e-12"), name
            assert max(abs(o - p) for o, p in zip(before[3:], before, strict=False)) < level * Decimal("6e-13"), name
            assert max(abs(o / w) for o, w in zip(off, want, strict=True)) < Decimal("5e-15"), name


def test_foundation(series):
    base = op.add_foundation(with_bar_index(series))
    got = chunked.add_foundation_in_chunks(series, size=SIZE)
    same(base, got, [c for c in base.columns if c not in (*series.columns, "bar_idx", "body_ratio", "body_ratio_above_60")])


@pytest.mark.parametrize("size", [SIZE, 512])
def test_structure(series, size):
    base = op.add_choch(op.add_bos(op.add_trend_state(op.add_swings(with_bar_index(series)))))
    got = chunked.add_structure_in_chunks(series, size=size)
    assert set(got.columns) == set(base.columns)
    same(base, got, [c for c in base.columns if c not in (*series.columns, "bar_idx")])


def test_long_series_takes_many_tasks(spark):
    """One series; no stage that computes its windows has a single task with all rows."""
    ticks = spark.range(40_000).selectExpr("'Z' AS instrument", "'M1' AS timeframe", "timestamp_seconds(id * 60) AS timestamp", "100 + id % 7 AS close").withColumns({"open": F.col("close") + 1, "high": F.col("close") + 2, "low": F.col("close") - 1, "volume": F.lit(1)})
    tasks = in_chunks(ticks, lambda d, k: op.add_volume_ratio(d, keys=k), 20).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 20_000
