import random

import pytest

from emberline.functions.patterns import Stage, matches

DAY = 86400


def frame(spark, rows):
    return spark.createDataFrame(rows, "instrument string, at long, side int, low double, high double, close double").selectExpr("instrument", "timestamp_seconds(at) AS at", "side", "low", "high", "close")


def brute(stages):
    """Each start with the first event that fits after each stage, one by one."""
    out = []
    for name, t, side, lo, hi, _ in set(stages[0][1]):
        times = [t]
        for _, rows, within, zone, closes in stages[1:]:
            fits = [r[1] for r in rows if r[0] == name and r[2] == side and times[-1] <= r[1] <= times[-1] + within and (not zone or (r[3] <= hi and r[4] >= lo)) and (not closes or (r[5] > hi if side == 1 else r[5] < lo))]
            if not fits:
                break
            times.append(min(fits))
        out.append((name, side, lo, hi, *times, *[None] * (len(stages) - len(times))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_combinations(spark, seed):
    rng = random.Random(seed)
    made = lambda n: [(rng.choice("AB"), rng.randrange(0, 40) * 3600, rng.choice([1, -1]), float(a := rng.randrange(90, 110)), float(a + rng.randrange(0, 6)), float(rng.randrange(88, 116))) for _ in range(n)]
    stages = [("a", made(40), 0, False, False), ("b", made(30), 5 * 3600, False, False), ("c", made(60), 8 * 3600, True, False), ("d", made(60), 6 * 3600, True, True)]
    got = matches([Stage(n, frame(spark, rows), within, zone, closes) for n, rows, within, zone, closes in stages])
    assert got.columns == ["instrument", "side", "low", "high", "a_at", "b_at", "c_at", "d_at"]
    rows = sorted([(*r[:4], *(int(t.timestamp()) if t else None for t in r[4:])) for r in map(tuple, got.collect())], key=repr)
    want = brute(stages)
    assert rows == want and sum(r[-1] is not None for r in want) > 1


def test_limits_are_included_and_missing_values_fit_nothing(spark):
    start = [("A", 0, 1, 10.0, 12.0, None), ("A", 0, 1, 10.0, 12.0, None), ("A", 5, -1, None, None, None)]
    after = [("A", DAY, 1, 12.0, 13.0, 13.0), ("A", 5, -1, 1.0, 99.0, 0.0), ("A", 1, 1, None, None, None), ("A", 2, None, 1.0, 99.0, 99.0)]
    got = matches([Stage("x", frame(spark, start)), Stage("y", frame(spark, after), DAY, zone=True)]).collect()
    assert {(r.side, r.y_at is not None and int(r.y_at.timestamp())) for r in got} == {(1, DAY), (-1, False)} and len(got) == 2
    late = matches([Stage("x", frame(spark, start[:1])), Stage("y", frame(spark, after[:1]), DAY - 1, zone=True)]).first()
    assert late.y_at is None
    assert matches([Stage("x", frame(spark, start).where("false")), Stage("y", frame(spark, after), DAY)]).count() == 0
    assert matches([Stage("x", frame(spark, start))]).count() == 2
