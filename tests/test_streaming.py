import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import operators as op
from emberline.functions.series import with_bar_index
from emberline.plans import setups
from emberline.sources import candles as src
from emberline.streaming import bars as streaming
from emberline.streaming.zones import ROCKS, stream_fvg_fill

from .helpers import candles, walk


def in_parts(spark, df, folder, parts):
    """df as a stream of files, one a batch, by the column `part`."""
    for p in range(parts):
        df.where(F.col("part") == p).coalesce(1).write.parquet(f"{folder}/step={p}")
    schema = T.StructType([*df.schema.fields, T.StructField("step", T.IntegerType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    yield
    spark.conf.unset(ROCKS[0]) if before is None else spark.conf.set(ROCKS[0], before)


def test_live_zones_in_small_batches_out_of_order(spark, rocks, tmp_path):
    rng = random.Random(5)
    df = op.add_fvg(op.ensure_atr(with_bar_index(candles(spark, walk(rng, 160)).union(candles(spark, walk(rng, 160), "B")))), 0.0)
    # Neighbouring bars change places, and some come three batches late, within the four days that are waited for.
    part = F.greatest(F.lit(0), F.floor((F.col("bar_idx") + F.pmod(F.col("bar_idx") * 7, F.lit(5))) / 40) + F.when(F.pmod("bar_idx", F.lit(11)) == 0, 1).otherwise(0)).cast("int")
    got = streaming.replay(spark, stream_fvg_fill(in_parts(spark, df.withColumn("part", part), tmp_path / "in", 6), "4 days"), "zones")
    want = op.add_fvg_fill(df)
    names = [c for c in got.columns if c != "timestamp"]
    rows = lambda d: sorted((tuple(r) for r in d.select("timestamp", *names).collect()), key=repr)
    a, b = rows(got), {r[:3]: r for r in rows(want)}
    assert len(a) >= 2 * (160 - 97) and all(b[r[:3]] == r for r in a) and len({r[:3] for r in a}) == len(a)
    assert sum(r[names.index("fvg_active_bull") + 1] for r in a) > 3


def test_two_timeframes_join_as_in_batch(spark, tmp_path):
    rng = random.Random(6)
    low = candles(spark, walk(rng, 200)).withColumn("part", F.floor(F.unix_timestamp("timestamp") / 86400 % 9).cast("int") % 4)
    high = candles(spark, walk(rng, 50), timeframe="H4", hours=4).withColumn("part", F.pmod(F.hash("timestamp"), F.lit(3)))
    joined = streaming.stream_as_of(in_parts(spark, low, tmp_path / "low", 4).drop("step"), in_parts(spark, high, tmp_path / "high", 3).drop("step"), ["close"], 4 * 3600, late="30 days")
    got = streaming.replay(spark, joined, "as_of")
    want = setups.as_of(low, high, ["close"], 4 * 3600).where("htf_close IS NOT NULL")
    rows = lambda d: sorted((r.timestamp, r.close, r.htf_close) for r in d.collect())
    assert rows(got) == rows(want) and got.count() == 196


def ticks(spark, seed=7, n=400):
    rng = random.Random(seed)
    begin = datetime(2024, 1, 1)
    rows = [("A" if rng.random() < 0.5 else "B", begin + timedelta(minutes=rng.randrange(0, 2880)), i, float(rng.randrange(50, 90))) for i in range(n)]
    return spark.createDataFrame(rows, "instrument string, ts timestamp, id long, price double")


def test_hopping_bars_and_sessions(spark, tmp_path):
    df = ticks(spark).withColumn("part", F.floor((F.unix_timestamp("ts") - 1704067200) / 28800).cast("int"))
    source = in_parts(spark, df, tmp_path / "in", 6)
    final = F.lit(df.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR")
    hops = streaming.replay(spark, streaming.stream_bars(source, "4 hours", "price", tie=("id",), slide="1 hour"), "hops")
    want = streaming.stream_bars(df, "4 hours", "price", tie=("id",), slide="1 hour").where(F.col("timestamp") + F.expr("INTERVAL 4 HOURS") <= final)
    assert sorted(map(tuple, hops.collect())) == sorted(map(tuple, want.collect())) and hops.count() > 60
    runs = streaming.replay(spark, streaming.stream_sessions(source, "20 minutes", "price", tie=("id",)), "runs")
    by_hand = []
    for name in "AB":
        run = []
        for r in [*sorted((r for r in df.collect() if r.instrument == name), key=lambda r: (r.ts, r.id)), None]:
            if run and (r is None or r.ts - run[-1].ts > timedelta(minutes=20)):
                by_hand.append((name, run[0].ts, run[-1].ts + timedelta(minutes=20), run[0].price, max(x.price for x in run), min(x.price for x in run), run[-1].price, len(run)))
                run = []
            run.append(r)
    last = df.agg(F.max("ts")).first()[0] - timedelta(hours=1)
    assert sorted(map(tuple, runs.collect())) == sorted(r for r in by_hand if r[2] <= last)


def test_late_ticks_are_those_that_bars_leave_out(spark, tmp_path):
    df = ticks(spark).withColumn("part", F.when(F.pmod("id", F.lit(9)) == 0, 3).otherwise(F.floor((F.unix_timestamp("ts") - 1704067200) / 57600)).cast("int"))
    source = in_parts(spark, df, tmp_path / "in", 4)
    late = streaming.count_late(spark, source, "1 hour", "late").groupBy("instrument", "timestamp").agg(F.sum("n_late").alias("n"))
    kept = streaming.replay(spark, streaming.stream_bars(source, "1 hour", "price", tie=("id",)), "kept")
    every = src.bars(df, "hour", "price", tie=("id",)).where(F.col("timestamp") + F.expr("INTERVAL 1 HOUR") <= F.lit(df.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR"))
    have, lost, total = ({(r.instrument, r.timestamp): r[c] for r in d.collect()} for d, c in ((kept, "volume"), (late, "n"), (every, "volume")))
    assert sum(lost.values()) > 10 and all(have.get(k, 0) + lost.get(k, 0) == n for k, n in total.items())
