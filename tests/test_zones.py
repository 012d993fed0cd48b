import random

import pytest
from pyspark.sql import functions as F

from emberline import operators as op
from emberline.operators.zones import equal_hl_pass, fvg_fill_pass, fvg_pass, ifvg_pass, ob_mitigation_pass

from .helpers import candles, column, walk


def gap(idx, lo, hi, size=1.0, bos=0):
    return {"bar_idx": idx, "gap": {"lo": lo, "hi": hi, "size": size, "body": 1.0, "bos": bos}}


def test_gaps_merge_within_reach_and_stay_at_the_first_bar():
    step = fvg_pass()[0]()
    a, b, c, far = gap(3, 1.0, 2.0), gap(4, 2.0, 3.0, 5.0, 1), gap(5, 2.5, 4.0), gap(6, 3.0, 5.0)
    out = step(3, [a, b, c], [])
    assert out[0] == 1 and out[2:4] == (1.0, 4.0) and out[6] == 5.0 and out[7] == 6 and out[9] == 3.0 and out[11] == 1
    assert step(4, [b, c, far], [])[0] == 0 and step(5, [c, far], [])[0] == 0
    assert step(6, [far], [])[2:4] == (3.0, 5.0)


def test_gaps_apart_do_not_merge():
    step = fvg_pass()[0]()
    a, b, c = gap(3, 1.0, 2.0), gap(4, 2.5, 3.0), gap(5, 1.5, 1.8)
    assert step(3, [a, b, c], [])[2:4] == (1.0, 2.0)
    # The third overlaps the first, but the second has come between.
    assert step(4, [b, c], [])[2:4] == (2.5, 3.0) and step(5, [c], [])[2:4] == (1.5, 1.8)


NONE = (0, None, None, -1)


def test_fill_of_exactly_one_ends_a_gap():
    step = fvg_fill_pass()[0]()
    assert step(1, 9, 9, 9, 1.0, 1, 4.0, 6.0, 2, *NONE)[0] == 0
    assert step(2, 9, 9, 9, 1.0, *NONE, *NONE)[0] == 0
    assert step(3, 9, 5, 9, 1.0, *NONE, *NONE)[:4] == (1, 0, 0.5, 1.0)
    out = step(4, 9, 4, 9, 1.0, *NONE, *NONE)
    assert out[0] == 0 and out[2] is None and out[12] == 1 and out[10] == 0
    assert step(5, 9, 3, 9, 1.0, *NONE, *NONE)[8] == 0


def test_newer_gaps_push_older_ones_out():
    step = fvg_fill_pass(track_last_n_bull=1)[0]()
    step(1, 9, 9, 9, 1.0, 1, 4.0, 6.0, 2, *NONE)
    step(2, 9, 9, 9, 1.0, 1, 7.0, 8.0, 3, *NONE)
    assert step(4, 9, 7.5, 9, 1.0, *NONE, *NONE)[2] == 0.5


@pytest.mark.parametrize(("mode", "at"), [("any", 4.0), ("mid", 5.0), ("deep", 6.0)])
def test_inversion_breaks_then_retests(mode, at):
    step = ifvg_pass(retest_mode=mode)[0]()
    step(1, 9, 9, 9, 2.0, 1, 4.0, 6.0, 2, *NONE)
    out = step(3, 5, 3, 3, 2.0, *NONE, *NONE)
    assert out[4] == 1 and out[6] == 1 and out[10] == 3 and out[12] == 2 and out[1] == 0
    assert step(4, at - 0.5, 3, 3, 2.0, *NONE, *NONE)[1] == 0
    out = step(5, at, 3, 3, 2.0, *NONE, *NONE)
    assert out[1] == 1 and out[2] == 1.0 and out[8] == 1 and out[10] == 4


def test_inversion_without_retest():
    step = ifvg_pass(require_retest=False)[0]()
    step(1, 1, 1, 1, None, *NONE, 1, 4.0, 6.0, 2)
    out = step(3, 9, 7, 7, None, *NONE, *NONE)
    assert out[0] == 1 and out[2] is None and out[9] == 4


def test_a_block_is_retested_and_broken_in_one_bar():
    step = ob_mitigation_pass()[0]()
    assert step(1, 9, 8, 1, 6.0, 5.0, 0, None, None) == (1, 0, 0)
    assert step(2, 9, 7, 0, None, None, 0, None, None) == (1, 0, 0)
    assert step(3, 9, 4, 0, None, None, 0, None, None) == (0, 0, 1)
    assert step(4, 9, 4, 0, None, None, 0, None, None) == (0, 0, 0)


def test_equal_highs_cluster_and_expire():
    step = equal_hl_pass(0.1)[0]()
    hit = lambda bar, p: step(bar, 0.0, 0.0, 10.0, p, None)[:10]
    assert hit(0, 100.0)[:2] == (0, 0)
    first = hit(5, 100.5)
    assert first[0] == 1 and first[1] == 2 and first[2] == 100.25 and first[3] == 0.5 and first[9] == 0
    carried = step(6, 0.0, 0.0, 10.0, None, None)
    assert carried[:3] == (0, 2, 100.25) and carried[5] is None and carried[7] == 1 and carried[9] == -1
    assert hit(9, 100.9)[1] == 3
    assert hit(70, 100.4)[0] == 0 and hit(71, 100.4)[9] == 1


def test_both_sides_can_be_swept_in_one_bar(spark):
    bars = [(10, 12, 8, 10)] * 15 + [(10, 13, 7, 10)]
    df = candles(spark, bars).withColumns({"last_swing_high": F.lit(12.0), "last_swing_low": F.lit(8.0), "swing_high_age": F.lit(80.0), "swing_low_age": F.lit(80.0)})
    out = column(op.add_liquidity_sweep(df), "sweep_high", "sweep_low", "sweep_side")
    assert out[-1] == (1, 1, 0)
    old = df.withColumn("swing_high_age", F.lit(81.0))
    assert column(op.add_liquidity_sweep(old), "sweep_high", "sweep_low", "sweep_side")[-1] == (0, 1, -1)


def test_too_wide_candles_are_passed_over(spark):
    quiet = [(10, 10.5, 9.5, 10)] * 20
    bars = [*quiet, (10, 11, 9, 9.5), (9.5, 30, 1, 8), (8, 9, 8, 9), (9, 10.2, 9, 10.2), (10.2, 12, 10, 12), (12, 14, 12, 14)]
    rows = column(op.add_ob(candles(spark, bars), require_bos=False, max_ob_width_atr=0.6), "ob_bull", "ob_bull_high", "ob_bull_low")
    assert rows[20] == (1, 10.0, 9.0) and rows[21][0] == 0
    assert column(op.add_ob(candles(spark, bars), require_bos=False, max_ob_width_atr=9.0), "ob_bull")[21] == 1


def test_zone_operators_without_inputs_and_in_batches(spark):
    df = candles(spark, walk(random.Random(1), 150))
    whole = op.add_ob_mitigation(op.add_ifvg(op.add_fvg_fill(op.add_fvg(df))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = op.add_ob_mitigation(op.add_ifvg(op.add_fvg_fill(op.add_fvg(df)))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts))
    bare = op.add_fvg_fill(df)
    assert bare.agg(F.sum("fvg_active_bull")).first()[0] == 0


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_a_plain_list(spark, seed):
    """Equal highs with every touch kept in a list of prices and bars, and all described from it anew."""
    df = op.add_swings(op.ensure_atr(candles(spark, walk(random.Random(seed), 250))), 2)
    rows = column(op.add_equal_hl(df, 0.5), "swing_high_price", "atr_14", "equal_highs", "equal_highs_count", "equal_highs_level", "equal_highs_width", "equal_highs_span", "equal_highs_cluster_id")
    clusters, ids = {}, 0
    shown = None
    for i, (price, atr, *got) in enumerate(rows):
        want = None
        if price is not None:
            clusters = {k: v for k, v in clusters.items() if i - v[-1][1] <= 50}
            level = {k: sorted(p for p, _ in v) for k, v in clusters.items()}
            level = {k: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for k, v in level.items()}
            near = [(abs(price - x), n, k) for n, (k, x) in enumerate(level.items()) if abs(price - x) <= 0.5 * atr]
            if near:
                key = min(near)[2]
                clusters[key].append((price, i))
            else:
                key, ids = ids, ids + 1
                clusters[key] = [(price, i)]
            touches = clusters[key]
            if len(touches) > 1:
                p = sorted(x for x, _ in touches)
                shown = (len(p), (p[(len(p) - 1) // 2] + p[len(p) // 2]) / 2, p[-1] - p[0], float(i - touches[0][1]))
                want = [1, *shown, key]
            if len(clusters) > 20:
                clusters = dict(sorted(sorted(clusters.items(), key=lambda c: c[1][-1][1])[-20:]))
        if want is None:
            want = [0, *shown, -1] if shown else [0, 0, None, None, None, -1]
        assert got == want, i
