import random

import pytest
from pyspark.sql import functions as F

from emberline import operators as op

from .helpers import candles, column, walk


def test_previous_week_over_new_year(spark):
    bars = [(i, i + 1, i - 1, i) for i in range(20)]
    rows = column(op.add_prev_week_hl(candles(spark, bars, start="2022-12-28", hours=24)), "timestamp", "prev_week_high")
    by = {str(t)[:10]: h for t, h in rows}
    # 1 January 2023 is a Sunday and belongs to week 52 of 2022.
    assert by["2023-01-01"] is None and by["2023-01-02"] == 5.0 and by["2023-01-09"] == 12.0


def test_previous_day_is_the_last_with_bars(spark):
    friday, monday = candles(spark, [(1, 5, 0, 1)], start="2024-01-05"), candles(spark, [(1, 9, 1, 6), (1, 3, 1, 1)], start="2024-01-08")
    assert column(op.add_prev_day_hl(friday.union(monday)), "prev_day_high", "above_prev_day_high", "below_prev_day_low") == [(None, 0, 0), (5.0, 1, 0), (5.0, 0, 0)]


def test_asian_range_takes_ten_sessions(spark):
    rows = [(5, 5 + d if h < 8 else 99, 5, 5) for d in range(1, 13) for h in range(24)]
    out = column(op.add_asian_session_hl(candles(spark, rows)), "asian_range", "asian_range_ratio")
    assert out[0] == (1.0, 1.0) and out[23] == (1.0, 1.0) and out[24] == (2.0, pytest.approx(2 / 1.5)) and out[-1] == (12.0, pytest.approx(12 / 7.5))
    late = candles(spark, rows[8:24], start="2024-01-01 08:00")
    assert set(column(op.add_asian_session_hl(late), "asian_range")) == {None}


def test_round_numbers_are_flagged_from_above_only(spark):
    df = candles(spark, [(1, 1, 1, c) for c in (2001, 1999, 2010)]).withColumn("atr_14", F.lit(5.0))
    assert column(op.add_round_number_flag(df, "XAU_USD"), "near_round_number") == [1, 0, 0]
    assert column(op.add_round_number_flag(df, "EUR_USD"), "near_round_number") == [0, 0, 0]
    assert column(op.add_round_number_flag(df.withColumn("instrument", F.lit("USOIL"))), "near_round_number") == [1, 0, 1]


def test_vwap_waits_for_volume(spark):
    out = column(op.compute_anchored_vwap(candles(spark, [(1, 1, 1, 1, 5), (3, 3, 3, 3, 0), (6, 6, 6, 6, 2), (6, 6, 6, 9, 2)]), 1), "avwap", "avwap_dev_sigma")
    assert out[0] == (None, None) and out[1] == (None, None) and out[2] == (6.0, 0.0) and out[3][0] == pytest.approx(6.5)


def test_volume_profile_of_a_flat_range_and_downward_ties(spark):
    flat = op.compute_volume_profile(candles(spark, [(5, 5, 5, 5)] * 3)).first()
    assert (flat.poc, flat.vah, flat.val, len(flat.bin_edges), sum(flat.profile)) == (5.0, 5.0, 5.0, 0, 0.0)
    bars = [(p, p, p, p, v) for p, v in ((0, 1), (50, 1), (25.5, 100), (24.5, 30), (26.5, 30))]
    one = op.compute_volume_profile(candles(spark, bars), n_bins=50).first()
    assert one.poc == 25.5 and one.val == 24.0 and one.vah == 26.0


def profile(bars, bins=50):
    low, high = min(b[2] for b in bars), max(b[1] for b in bars)
    sums = [0.0] * bins
    for b in bars:
        sums[min(bins - 1, int((sum(b[1:4]) / 3 - low) / (high - low) * bins))] += b[4]
    a = e = sums.index(max(sums))
    area = [a]
    while sum(sums[i] for i in area) < 0.7 * sum(sums):
        options = [(sums[i], i == a - 1, i) for i in (a - 1, e + 1) if 0 <= i < bins]
        area.append(max(options)[2])
        a, e = min(area), max(area)
    return low + (high - low) / bins * (sums.index(max(sums)) + 0.5), low + (high - low) / bins * (e + 1), low + (high - low) / bins * a


def test_volume_profile_moves_every_quarter(spark):
    bars = walk(random.Random(5), 150)
    out = column(op.add_volume_profile(candles(spark, bars)), "vp_poc", "vp_vah", "vp_val")
    assert out[79] == (None, None, None)
    for i in range(80, 150):
        anchor = 80 + (i - 80) // 20 * 20
        assert out[i] == pytest.approx(profile(bars[anchor - 80 : anchor]))


def test_sessions_and_calendar(spark):
    out = column(op.add_time_features(op.add_session_classifier(candles(spark, [(1, 1, 1, 1)] * 24, start="2024-01-05"))), "session", "hours_since_session", "is_dead_zone", "day_of_week", "is_friday")
    assert [r[0] for r in out] == [0] * 8 + [1] * 5 + [3] * 4 + [2] * 5 + [4] * 2
    assert out[9][1] == 1.0 and out[23] == (4, 1.0, 1, 4, 1)


def test_regime_with_missing_columns(spark):
    df = candles(spark, [(1, 1, 1, 1)] * 3)
    assert set(column(op.add_regime(df), "regime")) == {1}
    full = df.withColumns({"adx_14": F.lit(30.0), "hh_count": F.lit(2), "ema_20_slope": F.lit(-0.2)})
    assert set(column(op.add_regime(full), "regime_label")) == {"TRENDING"}
