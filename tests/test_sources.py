import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import operators as op
from emberline.plans import catalog, queries, setups
from emberline.plans.pipeline import INTRADAY_COLUMNS, build_all_indicators
from emberline.sources import candles as src
from emberline.streaming import bars as streaming

from .helpers import candles, column, walk

SF = "/root/testdata/sf0.001"


def test_landing_files_are_named_by_series(spark, tmp_path):
    raw = candles(spark, [(1, 2, 0, 1, 7), (1, 2, 0, 1, 8)]).drop("instrument", "timeframe").withColumnRenamed("volume", "tickVolume").withColumn("spread", F.lit(270))
    raw = raw.withColumn("tickVolume", F.when(F.col("tickVolume") == 7, F.col("tickVolume")))
    for name in ("XAU_USD_H1", "USOIL_D", "UNKNOWN_H1", "USOIL_M1"):
        raw.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    out = src.read_landing(spark, str(tmp_path))
    assert sorted((r.instrument, r.timeframe, r.volume, r.spread) for r in out.collect()) == [("USOIL", "D", 7, 270), ("XAU_USD", "H1", 7, 270)]


def test_database_round_trip(spark):
    """Appends twice to a database in memory and reads one series back; the conditions reach the database."""
    url = "jdbc:derby:memory:candles;create=true"
    kinds = {"createTableColumnTypes": "instrument varchar(20), timeframe varchar(8)"}
    mine = candles(spark, [(1, 2, 0, 1, 7), (1, 3, 0, 2, 8)], "XAU_USD")
    others = candles(spark, [(1, 2, 0, 1, 9)], "USOIL").union(candles(spark, [(1, 2, 0, 1, 9)], "XAU_USD", "D"))
    for part in (mine, others):
        src.write_jdbc(part.withColumns({"volume": F.col("volume").cast("long"), "spread": F.lit(270)}), url, **kinds)
    out = src.read_jdbc(spark, url, "XAU_USD", "H1")
    assert [(r.high, r.volume, r.spread) for r in out.orderBy("timestamp").collect()] == [(2.0, 7, 270), (3.0, 8, 270)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(instrument,XAU_USD)" in plan and "EqualTo(timeframe,H1)" in plan


DB = {"createTableColumnTypes": "instrument varchar(20), timeframe varchar(8)"}


def _rows(spark, url):
    return sorted((r.instrument, r.timestamp.hour, r.high) for r in spark.read.jdbc(url, "candles").collect())


def test_loads_that_are_repeated_or_break_off_leave_each_key_once(spark, monkeypatch):
    url = "jdbc:derby:memory:loads;create=true"
    bars = candles(spark, [(1, i, 0, 1, 7) for i in range(20)], "XAU_USD").withColumn("spread", F.lit(None).cast("int"))
    assert src.load_jdbc(bars.where("high < 8"), url, **DB) == 8
    want = _rows(spark, url)
    # A load that breaks off before its transaction: some rows are staged, none arrives, and no staging table stays.
    with monkeypatch.context() as m:
        m.setattr(src, "_properties", lambda *a, real=src._properties, calls=[]: (_ for _ in ()).throw(RuntimeError("lost")) if not calls and not calls.append(1) else real(*a))
        with pytest.raises(RuntimeError):
            src.load_jdbc(bars, url, **DB)
    assert _rows(spark, url) == want
    # Rows twice in the staged table, as a task that is tried again leaves them, and keys that are there already.
    assert src.load_jdbc(bars.union(bars), url, **DB) == 12
    assert src.load_jdbc(bars, url, **DB) == 0
    assert _rows(spark, url) == [("XAU_USD", i, float(i)) for i in range(20)]
    tables = spark.read.jdbc(url, "SYS.SYSTABLES").where("TABLETYPE = 'T'").collect()
    assert [r.TABLENAME for r in tables] == ["CANDLES"]


def test_a_series_is_read_by_several_tasks(spark):
    url = "jdbc:derby:memory:scan;create=true"
    src.load_jdbc(candles(spark, [(1, i, 0, 1, 7) for i in range(40)], "XAU_USD").union(candles(spark, [(1, 1, 0, 1, 7)], "USOIL")).withColumn("spread", F.lit(1)), url, **DB)
    out = src.read_jdbc(spark, url, "XAU_USD", "H1", parts=4)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 40 and max(r["count"] for r in sizes) <= 11
    assert src.read_jdbc(spark, url, "USOIL", "H1").count() == 1 and src.read_jdbc(spark, url, "NONE", "H1").count() == 0


def test_windows_over_a_bucketed_table_need_no_exchange(spark):
    bars = candles(spark, walk(random.Random(1), 50), "A").union(candles(spark, walk(random.Random(2), 50), "B"))
    src.save_bucketed(bars, "bucketed_candles", 4)
    table = spark.table("bucketed_candles")
    out = op.add_prev_day_hl(op.pivots(table))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    want = op.add_prev_day_hl(op.pivots(bars))
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    spark.sql("DROP TABLE bucketed_candles")


def test_landing_folders_round_trip(spark, tmp_path):
    bars = candles(spark, walk(random.Random(1), 30), "A").union(candles(spark, walk(random.Random(2), 30), "B"))
    src.write_landing(bars, f"file://{tmp_path}")
    back = src.read_landing(spark, f"file://{tmp_path}", ("A", "B"))
    assert sorted(map(tuple, back.drop("spread").collect())) == sorted(map(tuple, bars.withColumn("volume", F.col("volume").cast("long")).collect()))


def test_table_prunes_pushes_down_and_loads_once(spark, tmp_path):
    path = str(tmp_path / "candles")
    bars = candles(spark, walk(random.Random(1), 50), "A").union(candles(spark, walk(random.Random(2), 50), "B", "D", hours=24))
    src.write_candles(bars, path)
    src.append_candles(bars, path)
    assert spark.read.parquet(path).count() == 100
    part = src.load_candles(spark, path, "A", "H1", since=datetime(2024, 1, 2), until="2024-01-02 05:00:00")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert part.count() == 6 and "PartitionFilters: [isnotnull(instrument" in plan and "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan


def test_normalising_keeps_the_first_arrival(spark):
    rows = [("X", "H1", "2024-01-01 00:00:00", 2, 1.0), ("X", "H1", "2024-01-01 00:00:00", 1, 5.0), ("X", "H1", "2024-01-01 01:00:00", 3, 2.0)]
    out = src.normalise(spark.createDataFrame(rows, "instrument string, timeframe string, time string, n int, close double"), arrival="n")
    assert column(out, "close") == [5.0, 2.0]


def test_streamed_bars_equal_batch_bars(spark):
    stream = {(r.instrument, r.t): r for r in queries.stream_of_bars(spark, SF).collect()}
    ticks = spark.read.parquet(f"{SF}/events.parquet").withColumn("instrument", F.col("event_type"))
    batch = {(r.instrument, r.t): r for r in queries.shown(src.bars(ticks, "hour", "value", tie=("event_id",)), ["open", "high", "low", "close", "volume"]).collect()}
    assert stream and all(batch[k] == r for k, r in stream.items()) and len(batch) - len(stream) < 12


def test_streamed_phases_equal_batch_phases(spark, tmp_path):
    loose = {"accumulation_min_streak": 1, "atr_pct_low_threshold": 101, "box_width_pct_max": 9.0, "box_width_atr_max": 99, "efficiency_max": 2.0, "overlap_min": 0.0}
    df = op.add_amd_features(op.add_displacement_candle(candles(spark, walk(random.Random(3), 160), "A").union(candles(spark, walk(random.Random(4), 160), "B"))), **loose)
    want = op.add_amd_state(df)
    source = tmp_path / "in"
    for part in range(4):
        df.where((F.col("bar_idx") >= part * 40) & (F.col("bar_idx") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(str(source / f"part={part}"))
    read = spark.readStream.schema(T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())])).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    got = streaming.replay(spark, streaming.stream_phases(read), "phases")
    names = ["amd_phase", "amd_direction", "amd_sequence_id", "amd_bars_in_phase", "amd_active_box_high"]
    assert column(got, "instrument", *names) == column(want, "instrument", *names)


@pytest.mark.parametrize("mode", ["symmetric_causal", "symmetric", "causal"])
def test_pipeline_keeps_rows_and_adds_its_columns(spark, mode):
    bars = candles(spark, walk(random.Random(6), 260), "XAU_USD").union(candles(spark, walk(random.Random(7), 260), "EUR_USD", "D", hours=24))
    out = build_all_indicators(bars, swing_mode=mode, include_avwap=True).cache()
    assert out.count() == 520
    added = set(out.columns) - set(bars.columns) - {"bar_idx"}
    assert len(added) == {"causal": 227 + 6 - 14}.get(mode, 227 + 6)
    assert all(r is None for c in INTRADAY_COLUMNS for r in column(out.where("timeframe = 'D'"), c)) and column(out.where("timeframe = 'H1'"), "session")[0] == 0
    for f in ("fvg_bull", "bos_bear", "sweep_high", "ema_20_above_50", "near_round_number"):
        assert set(column(out, f)) <= {0, 1}
    assert all(v is None or 0 <= v <= 100 for v in column(out, "rsi_14")) and set(column(out, "trend_state")) <= {-1, 0, 1}
    assert out.where("vp_val > vp_poc or vp_poc > vp_vah").count() == 0
    out.unpersist()


def test_pipeline_is_one_shuffle_per_sequential_pass(spark):
    plan = build_all_indicators(candles(spark, [(1, 2, 0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_live_columns_do_not_change_when_bars_follow(spark):
    """The catalog's claim, held against the stack: what it calls live is the same without the bars after."""
    bars = walk(random.Random(11), 240)
    whole, part = (build_all_indicators(candles(spark, b, "XAU_USD")) for b in (bars, bars[:200]))
    names = catalog.live_columns(c for c in whole.columns if c not in ("instrument", "timeframe", "timestamp"))
    assert len(names) > 130 and "fvg_bull" not in names and "bos_bull" in names
    a, b = column(whole, *names)[:200], column(part, *names)
    changed: set[str] = set()
    for x, y in zip(a, b, strict=True):
        changed |= {n for n, u, v in zip(names, x, y, strict=True) if u != v}
    assert not changed


def test_confirmations_are_the_next_in_time(spark):
    low = candles(spark, [(0, 10, 0, 8)] * 12).withColumns({"choch_bear": F.lit(0), "choch_bull": F.when(F.hour("timestamp").isin(3, 6), 1).otherwise(0)})
    events = candles(spark, [(1, 1, 1, 1)] * 12).select("instrument", "timestamp", F.lit(1).alias("side"))
    got = column(setups.confirmed_below(events, low, 3600, 2 * 3600), "confirmed_at")
    # A bar of hour h is known at h + 1, and at that hour's bar in time.
    assert [t and t.hour for t in got] == [3, 3, 3, 6, 6, 6] + [None] * 6


def test_as_of_join_sees_closed_bars_only(spark):
    low = candles(spark, [(1, 1, 1, i) for i in range(10)])
    high = candles(spark, [(1, 1, 1, 100), (1, 1, 1, 200), (1, 1, 1, 300)], timeframe="H4", hours=4)
    assert column(setups.as_of(low, high, ["close"], 4 * 3600), "htf_close") == [None] * 4 + [100.0] * 4 + [200.0] * 2


def test_costs_events_and_smt(spark):
    df = candles(spark, [(1, 1, 1, 1)] * 60, "XAU_USD").withColumns({"side": F.lit(-1), "target": F.lit(10.0), "stop": F.lit(20.0), "spread": F.lit(270)})
    assert setups.with_costs(df).first()[-3:] == (0.5, 10.5, 19.5)
    assert setups.with_costs(df, use_spread=True).first().cost == 0.27
    events = spark.createDataFrame([(datetime(2024, 1, 2),), (datetime(2024, 1, 2),)], "event_ts timestamp")
    near = column(setups.near_events(df, events, 3), "near_event")
    assert [i for i, x in enumerate(near) if x] == list(range(21, 28))
    with pytest.raises(NotImplementedError):
        setups.add_smt_divergence(df, df)
