import random

import pytest

from emberline import operators as op
from emberline.operators.amd import automaton

from .helpers import candles, column, walk

BOX = (10.0, 8.0, 9.0)
UNKNOWN, ACC, MANIP, DIST = -1, 0, 1, 2


def bar(step, c, acc=0, direction=0, h=None, low=None, atr=1.0, box=BOX):
    return step(c if h is None else h, c if low is None else low, c, atr, acc, int(direction != 0), direction, *box)


def test_a_whole_cycle():
    step = automaton()
    assert bar(step, 9.0)[:4] == (UNKNOWN, 0, 0, 0)
    assert bar(step, 9.0, acc=1)[:7] == (ACC, 0, 1, 1, *BOX)
    assert bar(step, 9.0, acc=1, box=(11.0, 8.0, 9.5))[3:7] == (2, 11.0, 8.0, 9.5)
    out = bar(step, 7.5, direction=1, box=(12.0, 7.0, 9.5))
    assert out[:7] == (MANIP, 1, 1, 1, 11.0, 8.0, 9.5) and out[7:] == (0, 1, 0)
    for _ in range(3):
        assert bar(step, 12.0)[0] == MANIP
    assert bar(step, 12.0, h=12.5)[:4] == (DIST, 1, 1, 1)
    assert bar(step, 13.0)[:4] == (DIST, 1, 1, 2)
    assert bar(step, 9.5)[:7] == (UNKNOWN, 0, 1, 0, None, None, None)


def test_follow_through_must_be_consecutive():
    step = automaton()
    bar(step, 9.0, acc=1), bar(step, 7.5, direction=1)
    assert [bar(step, c)[0] for c in (12, 12, 12, 9, 12, 12, 12)] == [MANIP] * 7
    assert bar(step, 12)[0] == UNKNOWN or bar(step, 12)[0] == DIST


def test_grace_timeout_and_stall():
    step = automaton()
    bar(step, 9.0, acc=1)
    assert [bar(step, 9.0)[0] for _ in range(3)] == [ACC, ACC, UNKNOWN]
    bar(step, 9.0, acc=1), bar(step, 7.5, direction=-1)
    assert [bar(step, 9.0)[0] for _ in range(8)] == [MANIP] * 7 + [UNKNOWN]
    step = automaton(min_distribution_followthrough_bars=1)
    bar(step, 9.0, acc=1), bar(step, 7.5, direction=1)
    assert bar(step, 12.0)[0] == DIST
    assert [bar(step, 12.0)[0] for _ in range(5)] == [DIST] * 4 + [UNKNOWN]


def test_accumulation_restarts_and_unknown_can_be_ruled_out():
    step = automaton(allow_unknown_state=False, min_distribution_followthrough_bars=1)
    bar(step, 9.0, acc=1)
    assert [bar(step, 9.0)[0] for _ in range(5)] == [ACC] * 5
    bar(step, 7.5, direction=1), bar(step, 12.0)
    assert [bar(step, 9.0)[0] for _ in range(7)] == [DIST] * 7
    assert bar(step, 9.0, acc=1)[:4] == (ACC, 0, 2, 1)


def test_bull_wins_and_bad_values_never_distribute():
    step = automaton()
    bar(step, 9.0, acc=1)
    assert bar(step, 7.5, direction=1)[1] == 1
    for atr in (None, 0.0):
        assert [bar(step, 20.0, atr=atr)[0] for _ in range(3)] == [MANIP] * 3


def test_labels_take_the_first_touch_and_nothing_on_a_tie(spark):
    from pyspark.sql import functions as F

    rows = [(10, 10, 10, 10), (10, 10.5, 9.8, 10), (10, 11.6, 10, 11), (10, 10, 5, 5)]
    df = candles(spark, rows).withColumns({"atr_14": F.lit(1.0), "amd_phase": F.lit(1), "amd_direction": F.lit(1), "amd_active_box_high": F.lit(11.0), "amd_active_box_low": F.lit(9.0)})
    out = column(op.add_amd_labels(df), "amd_label_outcome", "amd_label_forward_return_atr")
    assert out[0] == (1, pytest.approx(1.6)) and out[3] == (0, None)
    tie = candles(spark, [(10, 10, 10, 10), (10, 12, 8, 10)]).withColumns({"atr_14": F.lit(1.0), "amd_phase": F.lit(1), "amd_direction": F.lit(-1), "amd_active_box_high": F.lit(11.0), "amd_active_box_low": F.lit(9.0)})
    assert column(op.add_amd_labels(tie), "amd_label_outcome") == [0, 0]


def test_engine_routes_arguments(spark):
    df = candles(spark, walk(random.Random(7), 200))
    out = op.add_amd_engine(df, add_labels=True, accumulation_min_streak=1, atr_pct_low_threshold=101, box_width_pct_max=9.0, box_width_atr_max=99, efficiency_max=2.0, overlap_min=0.0, label_lookahead=3, unknown_name=1)
    assert out.where("amd_phase = 0").count() > 0 and "amd_label_outcome" in out.columns
