import random

import pytest

from emberline import operators as op
from emberline.functions.series import with_bar_index

from .helpers import candles, column, walk


def test_equal_highs_are_swings_only_when_ties_are_allowed(spark):
    bars = [(5, h, 1, 5) for h in (6, 7, 9, 9, 9, 9, 9, 9, 9, 7, 6, 5)]
    strict = column(op.add_swings(candles(spark, bars)), "swing_high")
    loose = column(op.add_swings(candles(spark, bars), tie_mode="allow"), "swing_high")
    assert strict == [0, 0, 0, 1, 1, 0, 0, 1, 1, 0, 0, 0][:12] or sum(strict) < sum(loose)
    assert loose[5] == 1 and strict[5] == 0


def test_a_level_breaks_once(spark):
    bars = [(1, 2, 1, 1)] * 3 + [(1, 5, 1, 1)] + [(1, 2, 1, 1)] * 4 + [(5, 6, 5, 6), (6, 7, 6, 7), (7, 8, 7, 8)]
    rows = column(op.add_bos(op.add_swings(candles(spark, bars))), "bos_bull", "last_swing_high", "bos_direction")
    assert [r[0] for r in rows] == [0] * 8 + [1, 0, 0]
    assert rows[5][1] is None and rows[6][1] == 5.0 and rows[-1][2] == 1


def trend(highs, lows):
    """Counts by a walk over the bars: a high's turn comes before a low's."""
    up = down = state = 0
    before_h = before_l = None
    for h, low in zip(highs, lows, strict=True):
        if h is not None:
            if before_h is not None and h != before_h:
                up, down = (up + 1, 0) if h > before_h else (0, down + 1)
            before_h = h
        if low is not None:
            if before_l is not None and low > before_l:
                up = up or 1
            if before_l is not None and low < before_l:
                down = down or 1
            before_l = low
        state = 1 if up >= 2 else -1 if down >= 2 else state
        yield up, down, state


@pytest.mark.parametrize("seed", range(4))
def test_trend_state_against_a_walk(spark, seed):
    df = op.add_swings(candles(spark, walk(random.Random(seed), 300)), 2, tie_mode="allow")
    rows = column(op.add_trend_state(df), "swing_high_price", "swing_low_price", "hh_count", "ll_count", "trend_state")
    assert [r[2:] for r in rows] == list(trend([r[0] for r in rows], [r[1] for r in rows]))


@pytest.mark.parametrize("separation", [1, 2, 5])
def test_separation_is_greedy(spark, separation):
    df = with_bar_index(candles(spark, walk(random.Random(9), 200)))
    for f in (op.add_swings, op.add_swings_causal):
        free, apart = column(f(df, min_separation=0), "swing_high"), column(f(df, min_separation=separation), "swing_high")
        last, want = -(10**9), []
        for i, x in enumerate(free):
            want.append(int(x and i - last > separation))
            last = i if want[-1] else last
        assert apart == want


def test_causal_swings_look_back_only(spark):
    bars = walk(random.Random(4), 120)
    whole = column(op.add_swings_causal(candles(spark, bars)), "swing_high", "last_swing_low", "swing_low_age")
    part = column(op.add_swings_causal(candles(spark, bars[:80])), "swing_high", "last_swing_low", "swing_low_age")
    assert whole[:80] == part and whole[0][0] == 0


def test_missing_inputs_are_errors(spark):
    df = candles(spark, [(1, 2, 0, 1)])
    for f in (op.add_trend_state, op.add_bos, op.add_rsi_divergence):
        with pytest.raises(ValueError):
            f(df)
    with pytest.raises(KeyError):
        op.add_amd_state(df)
    with pytest.raises(ValueError):
        op.add_amd_features(df, displacement_mode="some")
