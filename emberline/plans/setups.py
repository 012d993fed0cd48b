"""Trade setups over enriched frames: how detectors' events stand to each other in time and price, within a series and between timeframes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.patterns import Stage, matches
from ..functions.scan import scan
from ..functions.series import FIRST, KEYS, flag, ordered, rows, so_far

# Spread and slippage per side, in price units.
COSTS = {"XAU_USD": (0.35, 0.15), "USOIL": (0.05, 0.02), "EUR_USD": (0.00015, 0.00005), "USD_JPY": (0.015, 0.005)}


def _any(columns: Sequence[str], lo: int, hi: int, keys: Sequence[str]) -> Column:
    """Whether one of the flags is up on any bar of the frame."""
    return F.coalesce(F.max(F.greatest(*columns, F.lit(0))).over(rows(lo, hi, keys)), F.lit(0)) == 1


def _side(bull: str, bear: str) -> Column:
    return F.greatest(F.col(bull), F.col(bear)) == 1


def add_fvg_context(df: DataFrame, sweep_within: int = 5, level_atr: float = 0.3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of gaps: sweep before, volume ratio at creation, overlap with volume profile levels, and CHoCH on or up to two bars after a retest."""
    made = _side("fvg_bull", "fvg_bear")
    low, high = F.coalesce("fvg_bull_low", "fvg_bear_low"), F.coalesce("fvg_bull_high", "fvg_bear_high")
    levels = [F.col(f"vp_{x}") for x in ("poc", "vah", "val")]
    inside = [(v >= low) & (v <= high) for v in levels]
    distance = F.least(*(F.when(i, 0.0).otherwise(F.least(F.abs(v - low), F.abs(v - high))) for v, i in zip(levels, inside, strict=True)))
    retest = F.coalesce(F.col("fvg_fill_pct") > 0, F.lit(False))
    return df.withColumns(
        {
            "sweep_preceded_fvg": flag(made & _any(("sweep_high", "sweep_low"), -sweep_within, -1, keys)),
            "fvg_creation_volume_ratio": F.when(made, F.col("vol_ratio")),
            "fvg_vp_distance_atr": F.when(made & (F.col("atr_14") > 0), distance / F.col("atr_14")),
            "fvg_at_vp_level": flag(made & (inside[0] | inside[1] | inside[2])),
            "choch_at_fvg_retest": flag(retest & _any(("choch_bull", "choch_bear"), 0, 2, keys)),
            "retest_quality": F.when(F.col("fvg_fill_pct").between(0.2, 0.5), "optimal").when(F.col("fvg_fill_pct") > 0.7, "absorbed").when(retest, "other"),
            "bos_at_vp_level": flag(_side("bos_bull", "bos_bear") & (F.least(*(F.abs(F.when(F.col("bos_bull") == 1, F.col("last_swing_high")).otherwise(F.col("last_swing_low")) - v) for v in levels)) <= level_atr * F.col("atr_14"))),
        }
    )


def add_block_context(df: DataFrame, within: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of order blocks: a gap within a few bars after, and first retests with falling volatility."""
    made = _side("ob_bull", "ob_bear")
    return df.withColumns(
        {
            "ob_has_fvg": flag(made & _any(("fvg_bull", "fvg_bear"), 1, within, keys)),
            "ob_retest_decelerating": flag((F.col("ob_first_retest") == 1) & (F.col("atr_ratio_rolling") < 1)),
        }
    )


def add_sweep_context(df: DataFrame) -> DataFrame:
    """Of sweeps: divergence, weak volume, prior tests of the level, and timing in the first two hours of London or New York."""
    high, low = F.col("sweep_high") == 1, F.col("sweep_low") == 1
    return df.withColumns(
        {
            "sweep_with_divergence": flag((high & (F.col("rsi_div_bearish") == 1)) | (low & (F.col("rsi_div_bullish") == 1))),
            "sweep_on_low_volume": flag((high | low) & (F.col("vol_below_avg") == 1)),
            "sweep_prior_tests": F.when(high, F.col("equal_highs_count")).when(low, F.col("equal_lows_count")),
            "sweep_in_session_open": flag((high | low) & _side("london_open", "ny_open")),
        }
    )


def add_zone_confluence(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sweeps whose level lies in the latest gap or order block of either side, known and live at that bar."""
    level = F.coalesce("sweep_level_high", "sweep_level_low")
    before = rows(FIRST, -1, keys)
    zones = {"fvg": ("fvg_bull", "fvg_bear"), "ob": ("ob_bull", "ob_bear")}
    live = {"fvg_bull": F.col("fvg_active_bull"), "fvg_bear": F.col("fvg_active_bear"), "ob_bull": F.col("ob_unmitigated_bull"), "ob_bear": F.col("ob_unmitigated_bear")}
    hit = lambda z: F.coalesce((level >= F.last(f"{z}_low", True).over(before)) & (level <= F.last(f"{z}_high", True).over(before)) & (live[z] == 1), F.lit(False))
    return df.withColumns({f"sweep_at_{name}": flag(hit(a) | hit(b)) for name, (a, b) in zones.items()})


def add_pullbacks(df: DataFrame, min_age: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """is_first_pullback_after_bos: the first bar against the break's direction since a break of structure of a swing of at least min_age bars."""
    df = df.withColumn("_id", F.sum(F.greatest("bos_bull", "bos_bear")).over(so_far(keys)))
    within = ordered([*keys, "_id"]).rowsBetween(FIRST, 0)
    against = (F.col("_id") > 0) & F.when(F.col("bos_direction") == 1, F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open")) & (F.greatest("bos_bull", "bos_bear") == 0)
    df = df.withColumn("_n", F.sum(flag(against)).over(within)).withColumn("_age", F.max("bos_swing_age").over(within))
    return df.withColumn("is_first_pullback_after_bos", flag(against & (F.col("_n") == 1) & (F.col("_age") >= min_age))).drop("_id", "_n", "_age")


def add_broken_level_sweep(df: DataFrame, within: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """bos_level_swept: after a break of structure a wick back through the broken level that closes on its far side again; 1 bull, -1 bear."""

    def start():
        level, side, age = None, 0, 0

        def step(bull: int, bear: int, high_level: float | None, low_level: float | None, h: float, low: float, c: float) -> tuple:
            nonlocal level, side, age
            out = 0
            if level is not None:
                age += 1
                if age > within:
                    level = None
                elif (low < level < c) if side == 1 else (h > level > c):
                    out, level = side, None
            if bull or bear:
                side = 1 if bull else -1
                level, age = (high_level if bull else low_level), 0
            return (out,)

        return step

    return scan(df, [(start, ["bos_bull", "bos_bear", "last_swing_high", "last_swing_low", "high", "low", "close"], [("bos_level_swept", T.IntegerType())])], keys)


def gated(df: DataFrame, regimes: Sequence[int] = (1, 2), sessions: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Bars in the regimes and sessions in which setups are taken."""
    return df.where(F.col("regime").isin(*regimes) & F.col("session").isin(*sessions) & (F.col("is_dead_zone") == 0))


def as_of(low: DataFrame, high: DataFrame, columns: Sequence[str], seconds: int, on: Sequence[str] = ("instrument",), prefix: str = "htf_") -> DataFrame:
    """low with the columns of the last bar of high that has closed by then: a bar's columns are known `seconds` after its timestamp.

    Both tables go into one order by time, where a higher bar precedes the lower ones that may see it, and the last values are carried on: one
    shuffle by instrument, no range join.
    """
    names = [f"{prefix}{c}" for c in columns]
    known = high.select(*on, F.timestamp_seconds(F.unix_timestamp("timestamp") + seconds).alias("_at"), F.lit(0).alias("_rank"), F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).alias("_htf"))
    w = Window.partitionBy(*on).orderBy("_at", "_rank").rowsBetween(FIRST, 0)
    body = [c for c in low.columns if c not in on]
    mine = low.select(*on, F.col("timestamp").alias("_at"), F.lit(1).alias("_rank"), F.struct(*body).alias("_row"))
    both = known.unionByName(mine, allowMissingColumns=True).withColumn("_seen", F.last("_htf", True).over(w))
    return both.where("_rank = 1").select(*on, "_row.*", *(F.col(f"_seen.{n}").alias(n) for n in names))


def with_costs(df: DataFrame, target: str = "target", stop: str = "stop", side: str = "side", use_spread: bool = False, points: float = 1000.0) -> DataFrame:
    """Target and stop moved by the cost of a side: a long's target down and stop up, a short's the other way. Unknown instruments cost nothing.

    The costs are a fixed table, or with use_spread the spread column where it is not missing, in points.
    """
    cost = F.lit(0.0)
    for name, (spread, slippage) in COSTS.items():
        cost = F.when(F.col("instrument") == name, spread + slippage).otherwise(cost)
    if use_spread:
        cost = F.coalesce(F.col("spread") / points, cost)
    sign = F.when(F.col(side) > 0, 1).otherwise(-1)
    return df.withColumns({"cost": cost, "target_net": F.col(target) - sign * cost, "stop_net": F.col(stop) + sign * cost})


def near_events(df: DataFrame, events: DataFrame, hours: int = 48, at: str = "event_ts", chunk: str = "1 day") -> DataFrame:
    """df with near_event: an event within so many hours before or after.

    Events and bars are cut into chunks of time. The last event before a bar, and the first after it, is one of its chunk's, or the last or first
    of the nearest chunk that has any: two windows within chunks, and one over a row a chunk. No bar meets more than one event on each side.
    """
    of = lambda c: F.window(c, chunk)["start"].alias("_chunk")
    times = events.select(F.col(at).cast("timestamp").alias("_e")).where("_e is not null").distinct()
    bounds = times.groupBy(of("_e")).agg(F.min("_e").alias("_first"), F.max("_e").alias("_last"))
    named = df.withColumn("_chunk", of("timestamp"))
    chunks = named.select("_chunk").distinct().join(bounds, "_chunk", "full")
    # One row for each chunk of time, however many bars and events it has.
    before, after = Window.orderBy("_chunk").rowsBetween(FIRST, -1), Window.orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.select("_chunk", F.last("_last", True).over(before).alias("_past"), F.first("_first", True).over(after).alias("_next"))
    mine = named.select("_chunk", F.col("timestamp").alias("_at"), F.struct(*df.columns).alias("_row"))
    both = times.select(of("_e"), F.col("_e").alias("_at"), F.col("_e")).unionByName(mine, allowMissingColumns=True)
    # Rows of one time see each other, so an event at a bar's own time counts.
    order = Window.partitionBy("_chunk").orderBy("_at")
    both = both.withColumns({"_a": F.last("_e", True).over(order), "_b": F.first("_e", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))}).where("_row is not null")
    both = both.join(chunks, "_chunk", "left")
    apart = lambda e: F.coalesce(F.abs(F.unix_timestamp(e) - F.unix_timestamp("_at")) <= hours * 3600, F.lit(False))
    return both.select("_row.*", flag(apart(F.coalesce("_a", "_past")) | apart(F.coalesce("_b", "_next"))).alias("near_event"))


def add_smt_divergence(df_primary: DataFrame, df_correlated: DataFrame, inverse: bool = True) -> DataFrame:
    """Divergence between correlated instruments is specified by name only; see smt_divergence for a definition of ours."""
    raise NotImplementedError("SMT divergence needs correlated instruments; use smt_divergence")


def smt_divergence(primary: DataFrame, other: DataFrame, inverse: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """At a swing of primary beyond its last one, whether the other instrument's last swing does not confirm it. Joined on timeframe and timestamp."""
    step = lambda side, sign: (F.col(f"swing_{side}_price") - F.last(f"swing_{side}_price", True).over(rows(FIRST, -1, keys))) * sign > 0
    made = {f"_new_{s}": flag(step(s, sign)) for s, sign in (("high", 1), ("low", -1))}
    seen = other.withColumns(made).withColumns({f"_other_{s}": F.last(F.when(F.col(f"swing_{s}") == 1, F.col(f"_new_{s}")), True).over(so_far(keys)) for s in ("high", "low")})
    seen = seen.select("timeframe", "timestamp", "_other_high", "_other_low")
    out = primary.withColumns(made).join(seen, ["timeframe", "timestamp"], "left")
    mirror = {"high": "low", "low": "high"} if inverse else {"high": "high", "low": "low"}
    missed = lambda s: (F.col(f"_new_{s}") == 1) & (F.col(f"_other_{mirror[s]}") == 0)
    return out.withColumns({"smt_bearish": flag(missed("high")), "smt_bullish": flag(missed("low"))}).drop("_new_high", "_new_low", "_other_high", "_other_low")


def add_phase_context(df: DataFrame, within: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of inverted gaps: a manipulation in the bars before, RSI divergence near it, and a rejection in the direction of the inversion on weak volume."""
    made = _side("ifvg_bull", "ifvg_bear")
    body = F.greatest("open", "close") - F.least("open", "close")
    wick = F.when(F.col("ifvg_bull") == 1, F.least("open", "close") - F.col("low")).otherwise(F.col("high") - F.greatest("open", "close"))
    right_way = F.when(F.col("ifvg_bull") == 1, F.col("close") > F.col("open")).otherwise(F.col("close") < F.col("open"))
    calm = F.when(F.col("ifvg_bull") == 1, F.col("rsi_14") > 45).otherwise(F.col("rsi_14") < 55)
    return df.withColumns(
        {
            "ifvg_after_manipulation": flag(made & _any(("amd_is_manipulation",), -within, 0, keys)),
            "ifvg_with_divergence": flag(made & _any(("rsi_div_bullish", "rsi_div_bearish"), -within, 0, keys)),
            "ifvg_rejection": flag(made & (wick > body) & right_way & calm & (F.col("vol_below_avg") == 1)),
        }
    )


def first_below(events: DataFrame, hits: DataFrame, seconds: int, within: int, name: str, on: Sequence[str] = ("instrument",)) -> DataFrame:
    """events (rows of a higher timeframe, a bar being known `seconds` after its timestamp) with the time of the first of the lower timeframe's hits
    within so many seconds after that; NULL if there is none.

    Hits go into one order by time with the events, latest first, and the last one seen is the next in time: no range join. on may have more
    columns that both sides share, a direction for instance.
    """
    marks = hits.select(*on, F.col("timestamp").alias("_at"), F.lit(0).alias("_rank"), F.col("timestamp").alias("_hit"))
    body = [c for c in events.columns if c not in on]
    mine = events.select(*on, F.timestamp_seconds(F.unix_timestamp("timestamp") + seconds).alias("_at"), F.lit(1).alias("_rank"), F.struct(*body).alias("_row"))
    w = Window.partitionBy(*on).orderBy(F.col("_at").desc(), "_rank").rowsBetween(FIRST, 0)
    both = marks.unionByName(mine, allowMissingColumns=True).withColumn("_next", F.last("_hit", True).over(w)).where("_rank = 1")
    near = F.unix_timestamp("_next") - F.unix_timestamp("_at") <= within
    return both.select(*on, "_row.*", F.when(near, F.col("_next")).alias(name))


def confirmed_below(events: DataFrame, low: DataFrame, seconds: int, within: int, on: Sequence[str] = ("instrument", "side")) -> DataFrame:
    """events, which have a side, with confirmed_at: the first CHoCH bar of that side of the lower timeframe whose body is at least 60 % of its range; see first_below."""
    sides = F.array_compact(F.array(F.when(F.col("choch_bull") == 1, 1), F.when(F.col("choch_bear") == 1, -1)))
    good = low.where(F.abs(F.col("close") - F.col("open")) >= 0.6 * (F.col("high") - F.col("low"))).withColumn("side", F.explode(sides))
    return first_below(events, good, seconds, within, "confirmed_at", on)


def rejections(low: DataFrame) -> DataFrame:
    """Bars that close the way of their side (1 up, -1 down) after a wick the other way longer than their body."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    up = (bottom - F.col("low") > top - bottom) & (F.col("close") > F.col("open"))
    down = (F.col("high") - top > top - bottom) & (F.col("close") < F.col("open"))
    return low.withColumn("side", F.when(up, 1).when(down, -1)).where("side is not null")


def rejected_below(events: DataFrame, low: DataFrame, seconds: int, within: int, on: Sequence[str] = ("instrument", "side")) -> DataFrame:
    """events, which have a side, with rejected_at: the first bar of the lower timeframe that rejects on that side; see first_below."""
    return first_below(events, rejections(low), seconds, within, "rejected_at", on)


def zone_entries(low: DataFrame, zones: DataFrame, zone_seconds: int, daily: DataFrame, daily_seconds: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """low with the last gap of a higher timeframe (htf_zone_low, htf_zone_high, htf_zone_side) and the daily trend (htf_bias) as they are known at each bar,
    in_htf_zone if the bar reaches into that gap, and zone_entry if the trend is of the gap's side too.

    zones are the higher bars with fvg_candidates: a gap is told by the bar after it, and is a zone until a later higher bar has gone all the way through it.
    """
    w = ordered(keys)
    gap = lambda s, side: F.struct(F.col(f"fvg_{s}_low").alias("low"), F.col(f"fvg_{s}_high").alias("high"), F.lit(side).alias("side"))
    told = zones.withColumn("_new", F.lag(F.when(F.col("fvg_bull") == 1, gap("bull", 1)).when(F.col("fvg_bear") == 1, gap("bear", -1))).over(w))
    told = told.withColumns({"_z": F.last("_new", True).over(so_far(keys)), "_id": F.count("_new").over(so_far(keys))})
    since = ordered([*keys, "_id"]).rowsBetween(FIRST, 0)
    later = F.col("_new").isNull()
    through = F.when(F.col("_z.side") == 1, F.min(F.when(later, F.col("low"))).over(since) <= F.col("_z.low")).otherwise(F.max(F.when(later, F.col("high"))).over(since) >= F.col("_z.high"))
    told = told.withColumn("_z", F.when(~F.coalesce(through, F.lit(False)), F.col("_z"))).select("instrument", "timestamp", *(F.col(f"_z.{x}").alias(f"zone_{x}") for x in ("low", "high", "side")))
    out = as_of(low, told, ["zone_low", "zone_high", "zone_side"], zone_seconds)
    out = as_of(out, daily.select("instrument", "timestamp", F.col("trend_state").alias("bias")), ["bias"], daily_seconds)
    inside = (F.col("low") <= F.col("htf_zone_high")) & (F.col("high") >= F.col("htf_zone_low"))
    return out.withColumns({"in_htf_zone": flag(inside), "zone_entry": flag(inside & (F.col("htf_bias") == F.col("htf_zone_side")))})


def closed(df: DataFrame, seconds: int) -> Column:
    """When a bar of so many seconds is known."""
    return F.timestamp_seconds(F.unix_timestamp("timestamp") + seconds)


def inversion_entries(gaps: DataFrame, inverted: DataFrame, changes: DataFrame, low: DataFrame, seconds: int, change_within: int = 5 * 86400, entry_within: int = 2 * 86400, keys: Sequence[str] = KEYS) -> DataFrame:
    """Inversions of a gap, then a CHoCH of the inversion's side on the same timeframe, then a bar of the lower one that rejects from the gap.

    gaps: higher bars with bar_idx; inverted: `relational.inversions` of them; changes: higher bars with choch_bull and choch_bear. low has rsi_14 and vol_below_avg: the bar
    wicks into the zone and closes out of it on the side of the inversion, on a volume below average, with an RSI over 45 (bull) or below 55 (bear).
    """
    told = gaps.select(*keys, F.col("bar_idx").alias("_back"), closed(gaps, seconds).alias("at"))
    starts = inverted.where("_back IS NOT NULL").join(told, [*keys, "_back"]).select("instrument", "at", (-F.col("_side")).alias("side"), F.col("_lo").alias("low"), F.col("_hi").alias("high"))
    turned = changes.select("instrument", closed(changes, seconds).alias("at"), F.explode(F.array_compact(F.array(F.when(F.col("choch_bull") == 1, 1), F.when(F.col("choch_bear") == 1, -1)))).alias("side"))
    calm = F.when(F.col("side") == 1, F.col("rsi_14") > 45).otherwise(F.col("rsi_14") < 55) & (F.col("vol_below_avg") == 1)
    return matches([Stage("inverted", starts), Stage("changed", turned, change_within), Stage("entry", _wicks(rejections(low).where(calm)), entry_within, zone=True, closes=True)])


def _wicks(rows: DataFrame) -> DataFrame:
    """Rejecting bars by the range of the wick that rejects: from the bar's extreme to its body, so that reaching a zone means wicking into it."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    up = F.col("side") == 1
    return rows.select("instrument", F.col("timestamp").alias("at"), "side", F.when(up, F.col("low")).otherwise(top).alias("low"), F.when(up, bottom).otherwise(F.col("high")).alias("high"), "close")


def block_entries(blocks: DataFrame, low: DataFrame, seconds: int, entry_within: int = 2 * 86400, within: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """First retests of an order block, then a bar of the lower timeframe that rejects from the block.

    blocks: higher bars with ob_first_retest_<side>, their edges and atr_ratio_rolling below 1: volatility falls into the block. low has macd_hist_delta and vol_above_avg: MACD
    turns the block's way, on a volume above average.
    """
    side = lambda name, s: F.when(F.col(f"ob_first_retest_{name}") == 1, F.struct(F.lit(s).alias("side"), F.col(f"ob_first_retest_{name}_low").alias("low"), F.col(f"ob_first_retest_{name}_high").alias("high")))
    calm = blocks.where(F.col("atr_ratio_rolling") < 1)
    starts = calm.select("instrument", closed(calm, seconds).alias("at"), F.explode(F.array_compact(F.array(side("bull", 1), side("bear", -1)))).alias("z")).select("instrument", "at", "z.*")
    turning = (F.col("macd_hist_delta") * F.col("side") > 0) & (F.col("vol_above_avg") == 1)
    return matches([Stage("retest", starts), Stage("entry", _wicks(rejections(low).where(turning)), entry_within, zone=True)])


def session_entries(sweeps: DataFrame, low: DataFrame, seconds: int, within: int = 86400) -> DataFrame:
    """Sweeps in the first two hours of London or New York, then a CHoCH of the lower timeframe against the swept side with a body of at least 60 % of its range.

    sweeps: higher bars with sweep_high, sweep_low, london_open, ny_open and hours_since_session; low has choch_bull and choch_bear. A swept high is bearish.
    """
    timely = sweeps.where(((F.col("london_open") == 1) | (F.col("ny_open") == 1)) & (F.col("hours_since_session") < 2))
    sides = lambda bull, bear: F.explode(F.array_compact(F.array(F.when(F.col(bull) == 1, 1), F.when(F.col(bear) == 1, -1)))).alias("side")
    starts = timely.select("instrument", closed(timely, seconds).alias("at"), sides("sweep_low", "sweep_high"))
    good = low.where(F.abs(F.col("close") - F.col("open")) >= 0.6 * (F.col("high") - F.col("low")))
    return matches([Stage("sweep", starts), Stage("change", good.select("instrument", F.col("timestamp").alias("at"), sides("choch_bull", "choch_bear")), within)])
