import math
import random

import pytest

from emberline import operators as op
from emberline.functions import recurrence as rec
from emberline.operators.foundation import smooth, true_range

from .helpers import candles, column, walk


def test_ema_is_seeded_by_the_first_value():
    step = rec.ema(3)
    assert [step(x) for x in (4.0, 8.0, None, 8.0)] == [4.0, 6.0, 6.0, 7.0]


def test_rma_waits_for_its_seed_and_repeats_over_gaps():
    step = rec.rma(3)
    assert [step(x) for x in (None, 3.0, 6.0, 9.0, None, 12.0)] == [None, None, None, 6.0, 6.0, pytest.approx(8.0)]


def test_wilder_sum():
    step = rec.wilder_sum(2)
    assert [step(x) for x in (1.0, 3.0, 5.0)] == [None, 4.0, 7.0]


def test_rsi_without_losses_and_without_changes(spark):
    up = candles(spark, [(i, i, i, i) for i in range(1, 20)])
    flat = candles(spark, [(5, 5, 5, 5)] * 19, instrument="Y")
    rows = column(op.add_rsi(up.union(flat)), "instrument", "rsi_14", "rsi_above_70")
    assert [r[1] for r in rows[:19]] == [None] * 14 + [100.0] * 5 and rows[18][2] == 1
    assert {r[1:] for r in rows[19:]} == {(None, 0)}


def test_adx_counts_its_warm_up_as_zeros(spark):
    rows = column(op.add_adx(candles(spark, [(i, i + 1, i - 1, i) for i in range(40)])), "adx_14")
    assert rows[:13] == [None] * 13 and rows[13] == pytest.approx(100 / 14)


def test_atr_warm_ups(spark):
    base = candles(spark, [(1, 3, 1, 2)] * 5 + [(1, 6, 1, 2)] * 15)
    assert column(op.ensure_atr(base), "atr_14")[:6] == [2.0] * 5 + [pytest.approx(2.5)]
    assert column(op.add_atr(base), "atr_14")[:14] == [None] * 13 + [pytest.approx((5 * 2 + 9 * 5) / 14)]


def test_several_series_do_not_mix(spark):
    rng = random.Random(1)
    a, b = walk(rng, 60), walk(rng, 60)
    both = op.add_foundation(candles(spark, a, "A").union(candles(spark, b, "B")))
    alone = op.add_foundation(candles(spark, b, "B"))
    names = [c for c in alone.columns if c not in ("instrument", "timeframe", "timestamp")]
    assert column(both.where("instrument = 'B'"), *names) == column(alone, *names)


def test_rank_and_bands_against_a_loop(spark):
    rng = random.Random(2)
    bars = walk(rng, 120)
    closes = [r[3] for r in bars]
    df = op.add_bb_width(candles(spark, bars))
    got = column(df, "bb_width", "bb_width_pct_50")
    widths = []
    for i in range(120):
        if i < 19:
            widths.append(None)
            continue
        w = closes[i - 19 : i + 1]
        m = sum(w) / 20
        widths.append(4 * math.sqrt(sum((x - m) ** 2 for x in w) / 19) / m)
    for i, (g, p) in enumerate(got):
        assert g == pytest.approx(widths[i]) if widths[i] is not None else g is None
        if i >= 68:
            last = [round(x, 10) for x in widths[i - 49 : i + 1]]
            assert p == pytest.approx((sum(x < last[-1] for x in last) + (sum(x == last[-1] for x in last) + 1) / 2) * 2)
        else:
            assert p is None


def test_smooth_runs_all_tasks_in_one_pass(spark):
    df = op.add_foundation(candles(spark, walk(random.Random(3), 30)))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert smooth(candles(spark, [(1, 2, 0, 1)]), [((("_tr"),), ("x",), lambda: rec.rma(1))]).first().x == 2.0
    assert candles(spark, [(1, 2, 0, 1)]).select(true_range()).first()[0] == 2.0


def test_length_is_another_name_of_period(spark):
    bars = candles(spark, walk(random.Random(8), 40))
    assert column(op.compute_ema(bars, 20, length=5), "ema_5") == column(op.compute_ema(bars, 5), "ema_5")
    assert column(op.add_rsi(bars, length=7), "rsi_7") == column(op.add_rsi(bars, 7), "rsi_7")


def test_ranks_do_not_depend_on_the_scale():
    values = [3.0, 1.0, 2.0, 2.0, 5.0, 1.0, 4.0]
    ranks = [[step(v * scale) for v in values] for scale, step in ((s, rec.rolling_rank(4)) for s in (1.0, 1e-12, 1e9))]
    assert ranks[0] == ranks[1] == ranks[2]
    step = rec.rolling_rank(2)
    step(0.3)
    assert step(0.1 + 0.2) == (75.0, 100.0)
