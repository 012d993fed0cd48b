"""Reference levels: anchored VWAP, Asian session, previous day and week, round numbers, volume profile.

All of them keep the series' partitioning: nothing is aggregated aside and joined back.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scan import Pass, scan
from ..functions.series import FIRST, KEYS, LAST, flag, ordered, ratio, rows, so_far, with_bar_index
from .foundation import with_atr

# The distance between round numbers, by instrument.
ROUND_STEPS = {"XAU_USD": 50.0, "USOIL": 5.0}


def compute_anchored_vwap(df: DataFrame, anchor: int | Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """VWAP of the typical price from bar number `anchor` on, with bands of one and two deviations; NULL before and while volume is 0."""
    df = with_bar_index(df, keys)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    on = F.col("bar_idx") >= anchor
    total = lambda x: F.sum(F.when(on, x)).over(so_far(keys))
    v = F.col("volume").cast("double")
    df = df.withColumns({"_v": total(v), "_pv": total(typical * v), "_ppv": total(typical * typical * v)})
    df = df.withColumn("avwap", F.when(on & (F.col("_v") > 0), F.col("_pv") / F.col("_v")))
    df = df.withColumn("_s", F.when(F.col("avwap").isNotNull(), F.sqrt(F.greatest(F.col("_ppv") / F.col("_v") - F.col("avwap") * F.col("avwap"), F.lit(0.0)))))
    bands = {f"avwap_{name}_{n}": F.col("avwap") + sign * n * F.col("_s") for n in (1, 2) for name, sign in (("upper", 1), ("lower", -1))}
    away = F.when(F.col("_s") > 0, (F.col("close") - F.col("avwap")) / F.col("_s")).when(F.col("_s") == 0, 0.0)
    return df.withColumns({**bands, "avwap_dev_sigma": away}).drop("_v", "_pv", "_ppv", "_s")


def add_avwap_from_last_swing(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The VWAP anchored at the series' last swing, or its start. The anchor looks over the whole series."""
    df = with_bar_index(df, keys)
    swing = (F.col("swing_high") == 1) | (F.col("swing_low") == 1)
    df = df.withColumn("_anchor", F.coalesce(F.max(F.when(swing, F.col("bar_idx"))).over(rows(FIRST, LAST, keys)), F.lit(0)))
    return compute_anchored_vwap(df, F.col("_anchor"), keys).drop("_anchor")


def add_asian_session_hl(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """High and low of each day's bars from 0 to 8 h UTC, on all bars of the day, and the range over its mean of ten sessions.

    Windows within the series' own partitioning instead of an aggregate that is joined back: a day is a part of a series.
    """
    df = df.withColumn("_date", F.to_date("timestamp"))
    day = Window.partitionBy(*keys, "_date")
    early = F.hour("timestamp") < 8
    df = df.withColumns({"asian_high": F.max(F.when(early, F.col("high"))).over(day), "asian_low": F.min(F.when(early, F.col("low"))).over(day)})
    df = df.withColumn("asian_range", F.col("asian_high") - F.col("asian_low"))
    # One bar stands for each session, so that ten of them are ten rows.
    df = df.withColumn("_one", F.coalesce(F.col("timestamp") == F.min(F.when(early, F.col("timestamp"))).over(day), F.lit(False)))
    ten = Window.partitionBy(*keys, "_one").orderBy("timestamp").rowsBetween(-9, 0)
    df = df.withColumn("_mean", F.when(F.col("_one"), F.avg("asian_range").over(ten)))
    return df.withColumn("asian_range_ratio", ratio(F.col("asian_range"), F.max("_mean").over(day))).drop("_date", "_one", "_mean")


def _previous(df: DataFrame, period: Column, name: str, keys: Sequence[str]) -> DataFrame:
    """The extremes of the period before this one, of those with bars: at a period's first bar the bar before knows them."""
    high, low = f"prev_{name}_high", f"prev_{name}_low"
    w = ordered(keys)
    df = df.withColumn("_period", period)
    whole = Window.partitionBy(*keys, "_period")
    df = df.withColumns({"_h": F.max("high").over(whole), "_l": F.min("low").over(whole)})
    begins = F.lag("_period").over(w) != F.col("_period")
    df = df.withColumns({"_ph": F.when(begins, F.lag("_h").over(w)), "_pl": F.when(begins, F.lag("_l").over(w))})
    df = df.withColumns({high: F.last("_ph", True).over(so_far(keys)), low: F.last("_pl", True).over(so_far(keys))})
    return df.withColumns({f"above_{high}": flag(F.col("close") > F.col(high)), f"below_{low}": flag(F.col("close") < F.col(low))}).drop("_period", "_h", "_l", "_ph", "_pl")


def add_prev_day_hl(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """High and low of the last day before that has bars."""
    return _previous(df, F.to_date("timestamp"), "day", keys)


def add_prev_week_hl(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """High and low of the last ISO week before that has bars."""
    week = F.extract(F.lit("YEAROFWEEK"), F.col("timestamp")) * 100 + F.weekofyear("timestamp")
    return _previous(df, week, "week", keys)


def add_round_number_flag(df: DataFrame, instrument: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Closes within 0.3 ATR of a round number. By the instrument column, or for all rows by the given name; others get 0.

    In the upper half of a step the distance is taken as half a step, so prices just under a round number are not flagged.
    """
    df = with_atr(df, keys)
    of = F.lit(instrument) if instrument is not None else F.col("instrument")
    step = F.lit(None).cast("double")
    for name, size in ROUND_STEPS.items():
        step = F.when(of == name, size).otherwise(step)
    distance = F.least(F.pmod(F.col("close"), step), step / 2)
    distance = F.least(distance, step - distance)
    return df.withColumn("near_round_number", flag(step.isNotNull() & (distance < 0.3 * F.col("atr_14"))))


def _value_area(profile: Column, low: Column, width: Column, bins: int, share: float) -> Column:
    """POC and value area of an array of volumes by bin: grown from the fullest bin to the fuller neighbour, down on ties."""
    start = (F.array_position(profile, F.array_max(profile)) - 1).cast("int")
    total = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x)

    def grow(s: Column, _: Column) -> Column:
        below = F.when(s["lo"] > 0, F.get(profile, s["lo"] - 1)).otherwise(0.0)
        above = F.when(s["hi"] < bins - 1, F.get(profile, s["hi"] + 1)).otherwise(0.0)
        open_ = (s["vol"] < total * share) & ((s["lo"] > 0) | (s["hi"] < bins - 1))
        down = open_ & (((below >= above) & (s["lo"] > 0)) | (s["hi"] >= bins - 1))
        up = open_ & ~down
        return F.struct((s["lo"] - down.cast("int")).alias("lo"), (s["hi"] + up.cast("int")).alias("hi"), (s["vol"] + F.when(down, below).when(up, above).otherwise(0.0)).alias("vol"))

    first = F.struct(start.alias("lo"), start.alias("hi"), F.get(profile, start).alias("vol"))
    area = F.aggregate(F.sequence(F.lit(1), F.lit(bins - 1)), first, grow)
    edge = lambda i: low + width * i
    return F.struct(edge(start + 0.5).alias("poc"), edge(area["hi"] + 1).alias("vah"), edge(area["lo"]).alias("val"))


def _profiles(bars: DataFrame, group: Sequence[str], bins: int, share: float = 0.7) -> DataFrame:
    """Per group of bars: profile (volume by bin of the typical price between the lowest low and the highest high), poc, vah, val.

    Without range the profile is all zero, and POC, VAH and VAL are that price.
    """
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    bars = bars.select(*group, "high", "low", typical.alias("typical"), F.col("volume").cast("double").alias("volume"))
    # One pass: the bins need the range first, so a group - at most a look-back of bars - is collected, then folded.
    rows_ = bars.groupBy(*group).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.collect_list(F.struct("typical", "volume")).alias("bars"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = lambda t: F.least(F.floor((t - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    binned = F.transform("bars", lambda b: F.struct(place(b["typical"]).alias("bin"), b["volume"].alias("volume")))
    rows_ = rows_.withColumn("binned", F.when(F.col("hi") > F.col("lo"), binned))
    sums = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.aggregate(F.filter("binned", lambda b: b["bin"] == i), F.lit(0.0), lambda a, b: a + b["volume"]))
    rows_ = rows_.withColumn("profile", F.when(F.col("binned").isNotNull(), sums).otherwise(F.array_repeat(F.lit(0.0), bins)))
    rows_ = rows_.withColumn("area", F.when(F.col("binned").isNotNull(), _value_area(F.col("profile"), F.col("lo"), width, bins, share)).otherwise(F.struct(F.col("lo").alias("poc"), F.col("hi").alias("vah"), F.col("lo").alias("val"))))
    return rows_.select(*group, "profile", F.col("lo").alias("price_min"), F.col("hi").alias("price_max"), "area.poc", "area.vah", "area.val")


def compute_volume_profile(df: DataFrame, lookback: int = 80, n_bins: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """The profile of each series' last `lookback` bars: poc, vah, val, profile and bin_edges."""
    latest = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc())
    bars = df.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= lookback)
    edges = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: F.col("price_min") + (F.col("price_max") - F.col("price_min")) / n_bins * i)
    out = _profiles(bars, keys, n_bins)
    return out.withColumn("bin_edges", F.when(F.col("price_max") > F.col("price_min"), edges).otherwise(F.array().cast("array<double>"))).drop("price_min", "price_max")


def volume_profile_pass(lookback: int = 80, n_bins: int = 50, share: float = 0.7) -> Pass:
    """vp_poc, vp_vah and vp_val of the `lookback` bars before the last of bars lookback, lookback + step, ..., with step = lookback // 4."""
    step_bars = max(lookback // 4, 1)

    def profile(bars: deque) -> tuple[float, float, float]:
        low, high = min(b[1] for b in bars), max(b[0] for b in bars)
        if high == low:
            return low, high, low
        sums = [0.0] * n_bins
        for h, lo, c, v in bars:
            sums[min(int(((h + lo + c) / 3 - low) / (high - low) * n_bins), n_bins - 1)] += v
        poc = a = b = sums.index(max(sums))
        inside, target = sums[poc], sum(sums) * share
        # Both sides of the fullest bin, outwards: of their next bins the fuller one joins, the lower on ties.
        for volume, side in heapq.merge(((v, -1) for v in reversed(sums[:poc])), ((v, 1) for v in sums[poc + 1 :]), key=lambda x: -x[0]):
            if inside >= target:
                break
            inside += volume
            a, b = (a - 1, b) if side < 0 else (a, b + 1)
        width = (high - low) / n_bins
        return low + width * (poc + 0.5), low + width * (b + 1), low + width * a

    def start() -> Callable:
        recent: deque = deque(maxlen=lookback)
        now: tuple = (None, None, None)

        def step(bar: int, h: float, lo: float, c: float, v: float) -> tuple:
            nonlocal now
            if bar >= lookback and (bar - lookback) % step_bars == 0:
                now = profile(recent)
            recent.append((h, lo, c, v or 0.0))
            return now

        return step

    return start, ["bar_idx", "high", "low", "close", "volume"], [(f"vp_{c}", T.DoubleType()) for c in ("poc", "vah", "val")]


def vp_distance() -> Column:
    return F.when(F.col("atr_14") > 0, F.abs(F.col("close") - F.col("vp_poc")) / F.col("atr_14"))


def add_volume_profile(df: DataFrame, lookback: int = 80, n_bins: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """See volume_profile_pass; and the distance of the close from the POC in ATRs."""
    df = scan(with_atr(with_bar_index(df, keys), keys), [volume_profile_pass(lookback, n_bins)], keys)
    return df.withColumn("vp_poc_distance_atr", vp_distance())
