import random

import pytest

from emberline import operators as op
from emberline.functions.series import with_bar_index
from emberline.functions.shared import stored
from emberline.operators.relational import add_ifvg_relational

from .helpers import candles, walk


@pytest.fixture(scope="module")
def gaps(spark):
    rng = random.Random(9)
    df = candles(spark, walk(rng, 420)).unionByName(candles(spark, walk(rng, 150), "Y"))
    return stored(op.add_fvg(op.ensure_atr(with_bar_index(df)), 0.0), "gaps")


@pytest.mark.parametrize("bound,mode,retest,size", [(1, "any", True, 16), (2, "mid", True, 512), (5, "deep", True, 16), (5, "any", False, 16), (10**6, "mid", True, 16)])
def test_same_as_the_pass(gaps, bound, mode, retest, size):
    options = {"require_retest": retest, "retest_mode": mode, "track_last_n_bull": bound, "track_last_n_bear": bound}
    whole = op.add_ifvg(gaps, **options)
    joined = add_ifvg_relational(gaps, size=size, **options)
    new = [c for c in whole.columns if c.startswith("ifvg_")]
    assert set(joined.columns) == set(whole.columns) and {c: t for c, t in joined.dtypes if c in new} == {c: t for c, t in whole.dtypes if c in new}
    get = lambda df: [tuple(r) for r in df.orderBy("instrument", "timestamp").select("instrument", "bar_idx", *new).collect()]
    a, b = get(whole), get(joined)
    assert a == b and sum(r[2] + r[3] for r in a) > 3
    assert "MapInArrow" not in joined._jdf.queryExecution().toString() and "Python" not in joined._jdf.queryExecution().toString()


def test_no_gaps(gaps):
    flat = gaps.where("fvg_bull = 0 AND fvg_bear = 0")
    row = add_ifvg_relational(flat).first()
    assert (row.ifvg_bull, row.ifvg_state_bear, row.ifvg_origin_idx_bull, row.ifvg_width_atr) == (0, 0, -1, None)
    assert add_ifvg_relational(gaps.where("false")).count() == 0
