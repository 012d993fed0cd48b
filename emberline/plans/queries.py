"""Queries over candles built from the driver's events, one or more per operator, and ad-hoc queries over the enriched frame.

The candles are bars of a walk in whole cents, so prices and ties are exact in any engine. Doubles are rounded to six digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import operators as op
from ..functions.chunks import in_chunks
from ..functions.series import KEYS, mean, with_bar_index
from ..functions.shared import shared_path, stored
from ..operators import chunked
from ..operators.amd import AMD_OUTPUTS
from ..operators.foundation import bollinger
from ..operators.relational import add_ifvg_relational, inversions
from ..sources import candles
from ..streaming import bars as streaming
from ..streaming.zones import ROCKS, stream_fvg_fill
from . import daily, setups
from .pipeline import build_all_indicators


def ticks(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """Events as ticks with a price of 2000 and a walk of whole cents; one: all events are one series.

    The walk is a running sum within each hour, plus the hours' sums before it: no task gets more than an hour's ticks of an instrument, or a row an hour.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("ALL").alias("instrument") if one else F.col("event_type").alias("instrument"), "ts", "event_id", "value")
    events = events.withColumns({"_hour": F.date_trunc("hour", "ts"), "_move": F.round(F.col("value") * 100).cast("long") - 4963})
    hours = events.groupBy("instrument", "_hour").agg(F.sum("_move").alias("_sum"))
    before = Window.partitionBy("instrument").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("instrument", "_hour", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("instrument", "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    walk = events.withColumn("_within", F.sum("_move").over(within)).join(hours, ["instrument", "_hour"])
    return walk.select("instrument", "ts", "event_id", "value", ((200000 + F.floor((F.col("_begin") + F.col("_within")) / F.lit(50.0))) / F.lit(100.0)).alias("price"))


def bars(spark: SparkSession, sf_dir: str, every: str = "hour", one: bool = False) -> DataFrame:
    return candles.bars(ticks(spark, sf_dir, one), every, "price", tie=("event_id",))


def enriched(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    return build_all_indicators(bars(spark, sf_dir, every), include_avwap=True)


def shown(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """instrument, t (seconds) and the columns, doubles rounded; sums of squares over a whole series, of which AVWAP is made, to two digits."""
    kinds = dict(df.dtypes)
    fix = lambda c: F.round(F.col(c), 2 if c.startswith("avwap") else digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c)
    return df.select("instrument", F.unix_timestamp("timestamp").alias("t"), *(fix(c) for c in columns))


def _query(operator: Callable[[DataFrame], DataFrame], every: str = "hour", digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    """The operator's new columns over the hourly bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = with_bar_index(bars(spark, sf_dir, every))
        out = operator(base)
        return shown(out, [c for c in out.columns if c not in base.columns], digits)

    return run


def _with_atr(operator: Callable[[DataFrame], DataFrame], *needed: Callable[[DataFrame], DataFrame], digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    """The same for an operator over a frame that has ATR and what `needed` add."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = with_bar_index(bars(spark, sf_dir))
        base = base if op.add_foundation in needed else op.ensure_atr(base)
        for f in needed:
            base = f(base)
        out = operator(base)
        return shown(out, [c for c in out.columns if c not in base.columns], digits)

    return run


def series_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir), [*candles.PRICES, "volume"])


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars(spark, sf_dir, "15 minutes", one=True), [*candles.PRICES, "volume"])


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line item prices by return flag; ticks of a day are in the order of their keys."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("instrument"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return shown(candles.bars(rows, "day", "l_extendedprice", tie=("l_orderkey", "l_linenumber")), [*candles.PRICES, "volume"])


def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bars(spark, sf_dir)
    low, middle, high = bollinger()
    return shown(base.withColumns({"sma_10": mean(F.col("close"), 10), "bb_low": low, "bb_middle": middle, "bb_high": high}), ["sma_10", "bb_low", "bb_middle", "bb_high"])


def normalised_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that arrive twice, in text form, brought into shape."""
    base = bars(spark, sf_dir).withColumn("time", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("timestamp")
    twice = base.withColumn("arrived", F.lit(1)).union(base.withColumn("close", F.col("close") + 1).withColumn("arrived", F.lit(2)))
    return shown(candles.normalise(twice, arrival="arrived").drop("arrived"), [*candles.PRICES, "volume"])


def candles_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as a candle table, loaded a second time to no effect, and read from a day on."""
    path = shared_path(spark, "candles")
    candles.write_candles(bars(spark, sf_dir), path)
    candles.append_candles(bars(spark, sf_dir), path)
    return shown(candles.load_candles(spark, path, since="2024-01-05 00:00:00"), [*candles.PRICES, "volume"])


def landing_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as a landing file for each series and read by the files' names."""
    path = shared_path(spark, "landing")
    base = stored(bars(spark, sf_dir), "candles")
    candles.write_landing(base, path)
    return shown(candles.read_landing(spark, path, [r.instrument for r in base.select("instrument").distinct().collect()]), [*candles.PRICES, "volume"])


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots over a table bucketed by series."""
    table = f"candles_{uuid.uuid4().hex}"
    candles.save_bucketed(bars(spark, sf_dir), table, 8)
    return shown(op.pivots(spark.table(table)), ["pivot_high", "pivot_low"])


def volume_profile_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.compute_volume_profile(bars(spark, sf_dir))
    return out.select("instrument", *(F.round(c, 6).alias(c) for c in ("poc", "vah", "val")), F.round(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x), 6).alias("volume"), F.size("bin_edges").cast("long").alias("n_edges"))


def atr_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = op.ensure_atr(with_bar_index(bars(spark, sf_dir)))
    return op.compute_atr_ratio(base, 100, 120, 120, 130).select("instrument", F.round("atr_ratio", 6).alias("atr_ratio"))


def _in_chunks(operator: Callable[[DataFrame, Sequence[str]], DataFrame], *made: str, back: int = 0, ahead: int = 0, atr: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """The new columns that begin as one of `made`, by an operator of bounded frames, over chunks of the hourly bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = stored(bars(spark, sf_dir), "candles")
        out = in_chunks(chunked.ensure_atr_in_chunks(base) if atr else base, operator, back, ahead)
        return shown(out, [c for c in out.columns if c.startswith(made) and c not in base.columns])

    return run


def _foundation(family: str, *made: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = chunked.add_foundation_in_chunks(stored(bars(spark, sf_dir), "candles"), (family,))
        return shown(out, [c for c in out.columns if c.startswith(made)])

    return run


def _structure(*made: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = chunked.add_structure_in_chunks(stored(bars(spark, sf_dir), "candles"))
        return shown(out, [c for c in out.columns if c.startswith(made)])

    return run


def resumed_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live stack over a table that grew in three runs: half of the time, then all but the last day of the second half, then everything once more."""
    base = stored(bars(spark, sf_dir), "candles")
    first, last = base.agg(F.min("timestamp"), F.max("timestamp")).first()
    path = shared_path(spark, "daily")
    for until in (first + (last - first) / 2, last - timedelta(days=1), last):
        daily.extend(base.where(F.col("timestamp") <= F.lit(until)), path)
    out = daily.stored_rows(spark, path)
    return shown(out, [c for c in out.columns if c not in (*KEYS, "timestamp", "run")])


def relational_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stored(op.add_fvg(op.ensure_atr(with_bar_index(bars(spark, sf_dir)))), "gaps")
    out = add_ifvg_relational(base)
    return shown(out, [c for c in out.columns if c not in base.columns])


def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enriched(spark, sf_dir)
    return shown(out, [c for c in out.columns if c not in (*KEYS, "timestamp")])


# The ad-hoc queries.


def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bars(spark, sf_dir)
    return shown(base.where(F.col("timestamp").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))), ["close", "volume"])


def detector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event of any detector: the flags are turned into rows."""
    flags = ("swing_high", "swing_low", "bos_bull", "bos_bear", "choch_bull", "choch_bear", "fvg_bull", "fvg_bear", "ifvg_bull", "ifvg_bear", "ob_bull", "ob_bear", "sweep_high", "sweep_low", "equal_highs", "equal_lows", "displacement_candle", "amd_is_manipulation")
    rows = enriched(spark, sf_dir).select("instrument", "timestamp", "close", *flags).unpivot(["instrument", "timestamp", "close"], list(flags), "detector", "on")
    return shown(rows.where("on = 1"), ["detector", "close"])


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' last five confirmed swing highs."""
    rows = op.add_swings(bars(spark, sf_dir)).where("swing_high = 1")
    latest = Window.partitionBy(*KEYS).orderBy(F.col("timestamp").desc())
    return shown(rows.withColumn("n", F.row_number().over(latest)).where("n <= 5"), ["n", "swing_high_price"])


def indicator_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("atr_14", "rsi_14", "adx_14", "macd_hist", "bb_width", "vol_ratio")
    rows = op.add_volume_ratio(op.add_foundation(with_bar_index(bars(spark, sf_dir)))).select("instrument", *columns).unpivot("instrument", list(columns), "indicator", "value")
    return rows.groupBy("instrument", "indicator").agg(*(F.round(f("value"), 6).alias(n) for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))))


def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("body_ratio_above_60", "vol_above_1_5x", "vol_below_0_8x", "vol_above_avg", "vol_below_avg", "vsa_absorption", "vsa_directional", "london_open", "ny_open", "is_dead_zone", "is_friday", "swing_high", "swing_low", "above_prev_day_high", "below_prev_day_low")
    rows = op.add_body_ratio(with_bar_index(bars(spark, sf_dir)))
    for f in (op.add_volume_ratio, op.add_key_volume_flags, op.add_vsa, op.add_swings, op.add_prev_day_hl):
        rows = f(rows)
    rows = op.add_time_features(op.add_session_classifier(rows)).select("instrument", *flags).unpivot("instrument", list(flags), "flag", "on")
    return rows.groupBy("instrument", "flag").agg(F.sum("on").cast("long").alias("n"), F.round(F.avg("on") * 100, 6).alias("percent"))


def regime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.add_regime(op.add_trend_state(op.add_swings(op.add_foundation(with_bar_index(bars(spark, sf_dir))))))
    share = F.round(F.count("*") * 100.0 / F.sum(F.count("*")).over(Window.partitionBy("instrument")), 6)
    return rows.groupBy("instrument", "regime_label").agg(F.count("*").alias("n"), share.alias("percent"))


def trend_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.add_trend_state(op.add_swings(with_bar_index(bars(spark, sf_dir))))
    label = F.when(F.col("trend_state") == 1, "BULL").when(F.col("trend_state") == -1, "BEAR").otherwise("UNDEFINED")
    return rows.groupBy("instrument", label.alias("trend")).agg(F.count("*").alias("n"))


def warm_up_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each series' first 200 bars miss an indicator."""
    rows = op.add_foundation(with_bar_index(bars(spark, sf_dir))).where("bar_idx < 200")
    missing = [F.col(c).isNull() for c in ("ema_20", "atr_14", "rsi_14", "adx_14", "macd_hist", "bb_width", "bb_width_pct_50")]
    anything = missing[0]
    for m in missing[1:]:
        anything = anything | m
    return rows.groupBy("instrument").agg(F.sum(anything.cast("long")).alias("n_missing"))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = op.add_body_ratio(bars(spark, sf_dir))
    latest = Window.partitionBy(*KEYS).orderBy(F.col("timestamp").desc())
    return shown(base.withColumn("n", F.row_number().over(latest)).where("n <= 3"), ["n", "close", "volume", "body_ratio"])


def series_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"), F.unix_timestamp(F.min("timestamp")).alias("first_t"), F.unix_timestamp(F.max("timestamp")).alias("last_t"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each series with its volume profile, reference levels and regime."""
    latest = Window.partitionBy(*KEYS).orderBy(F.col("timestamp").desc())
    last = enriched(spark, sf_dir).withColumn("n", F.row_number().over(latest)).where("n = 1")
    levels = [f"prev_{d}_{s}" for d in ("day", "week") for s in ("high", "low")]
    return shown(last, ["close", "vp_poc", "vp_vah", "vp_val", "vp_poc_distance_atr", *levels, "near_round_number", "regime", "regime_label"])


# Names of instruments for the series of the events.
_NAMED = {"click": "XAU_USD", "purchase": "USOIL", "view": "EUR_USD"}


def _named(df: DataFrame) -> DataFrame:
    """df with the series' names in `series` and instruments that rules know by name; prices of the second a tenth."""
    name = F.coalesce(*(F.when(F.col("instrument") == k, v) for k, v in _NAMED.items()), F.lit("USD_JPY"))
    df = df.withColumn("series", F.col("instrument")).withColumn("instrument", name)
    return df.withColumns({c: F.when(F.col("instrument") == "USOIL", F.col(c) / 10).otherwise(F.col(c)) for c in candles.PRICES})


def round_numbers_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.add_round_number_flag(op.ensure_atr(with_bar_index(_named(bars(spark, sf_dir)), ("series",)), keys=("series",)), keys=("series",))
    return shown(rows.withColumn("instrument", F.col("series")), ["near_round_number"])


def costs_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by the spread of each bar where it has one, else by its instrument."""
    rows = _named(bars(spark, sf_dir)).withColumns({"side": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1), "spread": F.when(F.col("volume") % 3 > 0, F.col("volume") * 10)})
    rows = setups.with_costs(rows.withColumns({"target": F.col("close") + F.col("side"), "stop": F.col("close") - F.col("side")}), use_spread=True)
    return shown(rows.withColumn("instrument", F.col("series")), ["cost", "target_net", "stop_net"])


# Setups and streams.


def _setup(*add: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = enriched(spark, sf_dir)
        out = base
        for f in add:
            out = f(out)
        return shown(out, [c for c in out.columns if c not in base.columns])

    return run


def higher_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the last closed 4-hour bar's close and trend."""
    high = op.add_trend_state(op.add_swings_causal(bars(spark, sf_dir, "4 hours")))
    return shown(setups.as_of(bars(spark, sf_dir), high, ["close", "trend_state"], 4 * 3600), ["close", "htf_close", "htf_trend_state"])


def confirmed_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweeps on 4-hour bars and the first change of character against the swept side on 15-minute bars within a day after."""
    high = bars(spark, sf_dir, "4 hours")
    sweeps = op.add_liquidity_sweep(op.add_swings(high)).where("sweep_side <> 0").select("instrument", "timestamp", "sweep_side", (-F.col("sweep_side")).alias("side"))
    low = op.add_choch(op.add_bos(op.add_trend_state(op.add_swings(bars(spark, sf_dir, "15 minutes")))))
    out = setups.confirmed_below(sweeps, low, 4 * 3600, 86400)
    return shown(out.withColumn("confirmed_t", F.unix_timestamp("confirmed_at")), ["sweep_side", "confirmed_t"])


def _rejected(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    out = setups.rejected_below(events.select("instrument", "timestamp", "side"), bars(spark, sf_dir, "15 minutes"), 3600, 7200)
    return shown(out.withColumn("rejected_t", F.unix_timestamp("rejected_at")), ["side", "rejected_t"])


def block_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First retests of hourly order blocks of one side, and the 15-minute bar that rejects there within two hours."""
    rows = op.add_ob_mitigation(op.add_ob(op.ensure_atr(with_bar_index(bars(spark, sf_dir)))), by_side=True)
    return _rejected(spark, sf_dir, rows.withColumn("side", F.col("ob_first_retest_bull") - F.col("ob_first_retest_bear")).where("side <> 0"))


def inversion_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly gap inversions of one side, and the 15-minute bar that rejects there within two hours."""
    rows = op.add_ifvg(op.add_fvg(op.ensure_atr(with_bar_index(bars(spark, sf_dir)))))
    return _rejected(spark, sf_dir, rows.withColumn("side", F.col("ifvg_bull") - F.col("ifvg_bear")).where("side <> 0"))


def zone_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars against the last 4-hour gap and the daily trend."""
    zones = op.add_fvg(op.ensure_atr(with_bar_index(bars(spark, sf_dir, "4 hours"))), merge_overlaps=False)
    daily = op.add_trend_state(op.add_swings_causal(bars(spark, sf_dir, "day")))
    out = setups.zone_entries(bars(spark, sf_dir), zones, 4 * 3600, daily, 86400)
    return shown(out, ["htf_zone_low", "htf_zone_high", "htf_zone_side", "htf_bias", "in_htf_zone", "zone_entry"])


def _times(df: DataFrame) -> DataFrame:
    """instrument, side, the zone and the stages' times in seconds."""
    return df.select("instrument", F.col("side").cast("long").alias("side"), *(F.round(c, 6).alias(f"zone_{c}") for c in ("low", "high")), *(F.unix_timestamp(c).alias(f"{c[:-3]}_t") for c in df.columns if c.endswith("_at")))


def _changing(df: DataFrame) -> DataFrame:
    return op.add_choch(op.add_bos(op.add_trend_state(op.add_swings(df))))


def inversion_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly gap inversions, a change of character of their side, and the 15-minute bar that rejects from the gap."""
    high = stored(_changing(op.add_fvg(op.ensure_atr(with_bar_index(bars(spark, sf_dir))))), "high")
    low = op.add_key_volume_flags(op.add_rsi(bars(spark, sf_dir, "15 minutes")))
    return _times(setups.inversion_entries(high, inversions(high), high, low, 3600))


def block_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First retests of hourly order blocks on falling volatility, and the 15-minute bar that rejects from the block."""
    high = op.add_ob_mitigation(op.add_ob(op.ensure_atr(with_bar_index(bars(spark, sf_dir)))), by_side=True)
    low = op.add_key_volume_flags(op.add_macd(bars(spark, sf_dir, "15 minutes")))
    return _times(setups.block_entries(op.add_rolling_atr_ratio(high), low, 3600))


def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sweeps in the first two hours of London or New York, and the change of character on 15-minute bars within a day."""
    high = op.add_session_classifier(op.add_liquidity_sweep(op.add_swings(bars(spark, sf_dir))))
    return _times(setups.session_entries(high, _changing(bars(spark, sf_dir, "15 minutes")), 3600))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumns({"instrument": F.lit("XAU_USD"), "series": F.col("instrument"), "side": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)})
    rows = setups.with_costs(rows.withColumns({"target": F.col("close") + F.col("side"), "stop": F.col("close") - F.col("side")}))
    return shown(rows.withColumn("instrument", F.col("series")), ["side", "cost", "target_net", "stop_net"])


def event_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 450").select(F.col("ts").alias("event_ts"))
    return shown(setups.near_events(bars(spark, sf_dir), events, 2), ["near_event"])


def smt(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = op.add_swings(bars(spark, sf_dir))
    first, second = both.where("instrument = 'click'"), both.where("instrument = 'purchase'")
    return shown(setups.smt_divergence(first, second), ["smt_bearish", "smt_bullish"])


def stream_of_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the raw event values, built by a stream that reads the table; bars still open at its end are not final and not written."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    made = streaming.stream_bars(events.withColumn("instrument", F.col("event_type")), "1 hour", "value", tie=("event_id",))
    return shown(streaming.replay(spark, made, "bars"), [*candles.PRICES, "volume"])


def _tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("instrument", F.col("event_type"))


def _bar_stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def stream_of_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of four hours that begin each hour, by a stream."""
    made = streaming.stream_bars(_tick_stream(spark, sf_dir), "4 hours", "value", tie=("event_id",), slide="1 hour")
    return shown(streaming.replay(spark, made, "hops"), [*candles.PRICES, "volume"])


def stream_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ticks at most half an hour apart, by a stream."""
    made = streaming.stream_sessions(_tick_stream(spark, sf_dir), "30 minutes", "value", tie=("event_id",))
    return shown(streaming.replay(spark, made, "sessions").withColumn("ends_t", F.unix_timestamp("ends")), ["ends_t", *candles.PRICES, "volume"])


def stream_of_two_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of hourly bars joined with one of 4-hour bars."""
    low, high = _bar_stream(spark, bars(spark, sf_dir), "low"), _bar_stream(spark, bars(spark, sf_dir, "4 hours"), "high")
    return shown(streaming.replay(spark, streaming.stream_as_of(low, high, ["close"], 4 * 3600), "both"), ["close", "htf_close"])


def stream_of_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How live gaps fill over a stream of hourly bars; the bars of the last hour are not final and not written."""
    source = _bar_stream(spark, op.add_fvg(op.ensure_atr(with_bar_index(bars(spark, sf_dir)))), "gaps")
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        out = streaming.replay(spark, stream_fvg_fill(source), "zones")
    finally:
        spark.conf.unset(ROCKS[0]) if before is None else spark.conf.set(ROCKS[0], before)
    return shown(out, [c for c in out.columns if c not in (*KEYS, "timestamp")])


# The candles' walk is too lively for the default thresholds ever to call it accumulation.
LOOSE = {"accumulation_min_streak": 3, "atr_pct_low_threshold": 80.0, "box_width_atr_max": 99.0, "box_width_pct_max": 9.0, "overlap_min": 0.1, "efficiency_max": 0.6}


def _loose(df: DataFrame) -> DataFrame:
    return op.add_amd_features(df, **LOOSE)


def stream_of_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase automaton over a stream of bars with features."""
    features = _loose(op.add_displacement_candle(op.ensure_atr(with_bar_index(bars(spark, sf_dir)))))
    path = shared_path(spark, "features")
    features.write.parquet(path)
    made = streaming.stream_phases(spark.readStream.schema(features.schema).parquet(path))
    return shown(streaming.replay(spark, made, "phases"), [n for n, _ in AMD_OUTPUTS])


_swings = op.add_swings
_causal = op.add_swings_causal
_trend = op.add_trend_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars_hourly": series_bars, "bars_dense": dense_bars, "bars_daily": daily_bars, "bars_normalised": normalised_bars, "candles_loaded": candles_loaded, "landing_read": landing_read, "pivots_bucketed": bucketed,
    "moving_averages": moving_averages, "emas": _query(op.add_emas), "atr": _query(op.add_atr), "adx": _query(op.add_adx), "rsi": _query(op.add_rsi), "macd": _query(op.add_macd), "atr_warm": _query(op.ensure_atr),
    "ema_of_high": _query(lambda d: op.compute_ema(d, 10, "high")),
    "bb_width": _query(op.add_bb_width), "body_ratio": _query(op.add_body_ratio), "rolling_atr_ratio": _with_atr(op.add_rolling_atr_ratio), "atr_ratio": atr_ratio,
    "volume_ratio": _query(op.add_volume_ratio), "key_volume_flags": _query(op.add_key_volume_flags), "candle_delta_proxy": _query(op.add_candle_delta_proxy), "vsa": _query(op.add_vsa), "wick_ratio": _query(op.add_wick_ratio),
    "displacement_candle": _with_atr(op.add_displacement_candle),
    "swings": _with_atr(_swings), "swings_at_once": _with_atr(lambda d: op.add_swings(d, causal=False, tie_mode="allow")), "swings_apart": _with_atr(lambda d: op.add_swings(d, min_separation=6, min_prominence_atr=0.5)),
    "swings_causal": _with_atr(_causal), "pivots": _query(op.pivots), "last_pivots": _query(op.last_pivots),
    "trend_state": _with_atr(_trend, _swings), "bos": _with_atr(op.add_bos, _swings), "choch": _with_atr(op.add_choch, _swings, _trend, op.add_bos), "rsi_divergence": _with_atr(op.add_rsi_divergence, _swings),
    "liquidity_sweep": _with_atr(op.add_liquidity_sweep, _swings), "liquidity_sweep_confirmed": _with_atr(lambda d: op.add_liquidity_sweep(d, require_next_bar_confirmation=True, confirmation_mode="mid", use_provided_swings=False)),
    "fvg_candidates": _with_atr(lambda d: op.add_fvg(d, merge_overlaps=False)), "fvg": _with_atr(op.add_fvg), "fvg_fill": _with_atr(op.add_fvg_fill, op.add_fvg), "ifvg": _with_atr(op.add_ifvg, op.add_fvg),
    "fvg_fill_all": _with_atr(lambda d: op.add_fvg_fill(d, track_last_n_bull=10**6, track_last_n_bear=10**6), op.add_fvg), "ob_mitigation_all": _with_atr(lambda d: op.add_ob_mitigation(d, keep_last_n=10**6), op.add_ob),
    "order_blocks": _with_atr(op.add_ob), "ob_mitigation": _with_atr(op.add_ob_mitigation, op.add_ob), "equal_hl": _with_atr(op.add_equal_hl, _swings),
    "amd_features": _with_atr(op.add_amd_features, op.add_displacement_candle), "amd_state": _with_atr(op.add_amd_state, op.add_displacement_candle, _loose), "amd_labels": _with_atr(op.add_amd_labels, op.add_displacement_candle, _loose, op.add_amd_state),
    "amd_engine": _with_atr(lambda d: op.add_amd_engine(d, add_labels=True, **LOOSE)),
    "anchored_vwap": _query(lambda d: op.compute_anchored_vwap(d, 50)), "avwap_from_last_swing": _with_atr(op.add_avwap_from_last_swing, _swings),
    "asian_session": _query(op.add_asian_session_hl), "prev_day": _query(op.add_prev_day_hl), "prev_week": _query(op.add_prev_week_hl), "round_numbers": _with_atr(lambda d: op.add_round_number_flag(d, "XAU_USD")),
    "session": _query(op.add_session_classifier), "time_features": _query(op.add_time_features), "regime": _with_atr(op.add_regime, op.add_foundation, _swings, _trend),
    "volume_profile": _with_atr(op.add_volume_profile), "volume_profile_last": volume_profile_last, "full_pipeline": full_pipeline,
    "chunked_emas": _foundation("emas", "ema_", "price_above_ema_", "atr_14"), "chunked_atr": _foundation("atr", "atr_"), "chunked_adx": _foundation("adx", "adx_"), "chunked_rsi": _foundation("rsi", "rsi_"), "chunked_macd": _foundation("macd", "macd_"),
    "chunked_bb_width": _foundation("bb_width", "bb_width"),
    "chunked_swings": _structure("swing_", "last_swing_"), "chunked_trend_state": _structure("trend_state", "hh_count", "ll_count"), "chunked_bos": _structure("bos_"), "chunked_choch": _structure("choch_"),
    "chunked_volume_ratio": _in_chunks(lambda d, k: op.add_volume_ratio(d, keys=k), "vol_", back=20, atr=False), "chunked_rolling_atr_ratio": _in_chunks(lambda d, k: op.add_rolling_atr_ratio(d, keys=k), "atr_ratio", back=10),
    "ifvg_relational": relational_inversions, "resumed_stack": resumed_stack,
    "setup_fvg": _setup(setups.add_fvg_context), "setup_blocks": _setup(setups.add_block_context), "setup_sweeps": _setup(setups.add_sweep_context, setups.add_zone_confluence), "setup_pullbacks": _setup(setups.add_pullbacks, setups.add_broken_level_sweep),
    "setup_phases": _setup(setups.add_phase_context), "setup_confirmed": confirmed_sweeps, "setup_block_rejection": block_rejections, "setup_inversion_rejection": inversion_rejections, "setup_zone_entry": zone_entries, "setup_inversion_entry": inversion_entries, "setup_block_entry": block_entries, "setup_session_entry": session_entries,
    "setup_gated": lambda spark, sf_dir: shown(setups.gated(enriched(spark, sf_dir)), ["close", "regime", "session"]), "higher_timeframe": higher_timeframe, "costs": costs, "event_proximity": event_proximity, "smt_divergence": smt, "stream_bars": stream_of_bars, "stream_phases": stream_of_phases,
    "stream_hops": stream_of_hops, "stream_sessions": stream_of_sessions, "stream_two_timeframes": stream_of_two_timeframes, "stream_zones": stream_of_zones,
    "q_time_slice": time_slice, "q_detector_events": detector_events, "q_last_events": last_events, "q_indicator_ranges": indicator_ranges, "q_flag_rates": flag_rates, "q_regime_distribution": regime_distribution,
    "q_trend_distribution": trend_distribution, "q_warm_up_gaps": warm_up_gaps, "q_latest_rows": latest_rows, "q_series_coverage": series_coverage, "q_latest_snapshot": latest_snapshot,
    "round_numbers_named": round_numbers_named, "setup_costs_spread": costs_spread,
}
