"""Gap inversions as joins of zones and bars: `add_ifvg` without a pass over the series.

A zone is live from its bar to the bar at which newer zones of its side push it out. Zones and bars meet in chunks of bars: a zone first meets one row a chunk, the
chunk's extremes, and only the bars of the chunk in which the condition is first met are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import CHUNK, SIZE, joined, numbered
from ..functions.series import KEYS
from ..functions.shared import stored
from .zones import DEPTHS

SIDES = {"bull": 1, "bear": -1}
ID = ("_side", "_from")


def zone_table(df: DataFrame, keep: dict[str, int], keys: Sequence[str]) -> DataFrame:
    """One row per gap: its side, bar, edges and confirming bar, and `_end`, the first bar at which it is not live any more."""
    last = df.groupBy(*keys).agg((F.max("bar_idx") + 1).alias("_bars"))
    each = []
    for side, sign in SIDES.items():
        confirm = F.col(f"fvg_{side}_confirm_idx")
        gaps = df.where((F.col(f"fvg_{side}") == 1) & F.col(f"fvg_{side}_low").isNotNull())
        gaps = gaps.select(*keys, F.lit(sign).alias("_side"), F.col("bar_idx").alias("_from"), F.col(f"fvg_{side}_low").alias("_lo"), F.col(f"fvg_{side}_high").alias("_hi"), F.when(confirm >= 0, confirm).otherwise(F.col("bar_idx") + 1).alias("_confirm"))
        each.append(gaps.withColumn("_end", F.lead("_from", keep[side]).over(Window.partitionBy(*keys).orderBy("_from"))))
    zones = joined(each[0].unionByName(each[1]), last, keys)
    return zones.withColumn("_end", F.coalesce("_end", "_bars")).drop("_bars")


def first_bar(zones: DataFrame, bars: DataFrame, name: str, after: str, value: tuple[Column, Column], bound: Column, below: bool, keys: Sequence[str], size: int) -> DataFrame:
    """zones with `name`, the first bar after bar `after` and before `_end` at which value is below (or, at or above) bound; NULL if there is none.

    value is for both sides, (bull, bear). A chunk between those of `after` and of the first that can hold the bar is met by its extreme only.
    """
    side = F.when(F.col("_side") == 1, value[0]).otherwise(value[1])
    meets = lambda v: v < bound if below else v >= bound
    extreme = F.min if below else F.max
    ends = bars.groupBy(*keys, CHUNK).agg(extreme(value[0]).alias("_x_bull"), extreme(value[1]).alias("_x_bear"))
    chunk = lambda c: F.floor(c / size).cast("int")
    open_ = zones.where(F.col(after).isNotNull() & (F.col(after) + 1 < F.col("_end")))
    spans = open_.withColumn(CHUNK, F.explode(F.sequence(chunk(F.col(after) + 1), chunk(F.col("_end") - 1))))
    hit = joined(spans, ends, [*keys, CHUNK]).where(meets(F.when(F.col("_side") == 1, F.col("_x_bull")).otherwise(F.col("_x_bear"))))
    begins = F.col(CHUNK) == chunk(F.col(after) + 1)
    near = hit.groupBy(*keys, *ID).agg(F.min(F.when(begins, F.col(CHUNK))).alias("_a"), F.min(F.when(~begins, F.col(CHUNK))).alias("_b"))
    near = near.select(*keys, *ID, F.explode(F.array_compact(F.array("_a", "_b"))).alias(CHUNK))
    pairs = joined(joined(near, open_, [*keys, *ID]), bars, [*keys, CHUNK])
    inside = (F.col("bar_idx") > F.col(after)) & (F.col("bar_idx") < F.col("_end"))
    found = pairs.where(inside & meets(side)).groupBy(*keys, *ID).agg(F.min("bar_idx").alias(name))
    return joined(zones, found, [*keys, *ID], "left")


def inversions(df: DataFrame, *, require_retest: bool = True, retest_mode: str = "any", track_last_n_bull: int = 5, track_last_n_bear: int = 5, keys: Sequence[str] = KEYS, size: int = SIZE) -> DataFrame:
    """A stored table of all gaps: keys, `_side`, `_from`, `_confirm`, `_end`, `_lo` and `_hi` as in zone_table, `_broken`, the bar that closes beyond it, and `_back`, the bar at which it inverts."""
    df = numbered(df, keys, size)
    bars = df.select(*keys, CHUNK, "bar_idx", "high", "low", "close")
    zones = zone_table(df, {"bull": track_last_n_bull, "bear": track_last_n_bear}, keys)
    sign = F.col("_side")
    edge = F.when(sign == 1, F.col("_lo")).otherwise(-F.col("_hi"))
    zones = first_bar(stored(zones, "zones"), bars, "_broken", "_confirm", (F.col("close"), -F.col("close")), edge, True, keys, size)
    if require_retest:
        middle = (F.col("_lo") + F.col("_hi")) / 2
        depth = DEPTHS.index(retest_mode) if retest_mode in DEPTHS else 0
        level = F.when(sign == 1, (F.col("_lo"), middle, F.col("_hi"))[depth]).otherwise(-(F.col("_hi"), middle, F.col("_lo"))[depth])
        zones = first_bar(stored(zones, "broken"), bars, "_back", "_broken", (F.col("high"), -F.col("low")), level, False, keys, size)
    else:
        zones = zones.withColumn("_back", F.col("_broken"))
    return stored(zones, "inverted")


def add_ifvg_relational(df: DataFrame, *, require_retest: bool = True, keys: Sequence[str] = KEYS, size: int = SIZE, **options: object) -> DataFrame:
    """The columns of add_ifvg for a table (best a stored one: it is read several times) that has bar_idx, atr_14 and the gaps' columns.

    Zones, some tenth of the bars, are written when a step has been found of all. A zone's live bars number about track_last_n times the distance of gaps, and with
    them the rows that meet.
    """
    df = numbered(df, keys, size)
    bars = df.select(*keys, CHUNK, "bar_idx")
    zones = inversions(df, require_retest=require_retest, keys=keys, size=size, **options)
    sign = F.col("_side")

    # A gap of one side inverts to the other's.
    other = {"bull": -1, "bear": 1}
    at = lambda c, s: F.max(F.when((sign == other[s]) & (F.col("_at") == F.col(c)), 1))
    events = zones.withColumn("_at", F.explode(F.array_distinct(F.array_compact(F.array("_broken", "_back")))))
    wide = F.when(F.col("_at") == F.col("_back"), F.struct("_from", (F.col("_hi") - F.col("_lo")).alias("width")))
    flags = [x for s in SIDES for x in (at("_back", s).alias(f"_inverted_{s}"), at("_broken", s).alias(f"_broken_{s}"), F.max(F.when(sign == other[s], wide)).alias(f"_wide_{s}"))]
    events = events.groupBy(*keys, F.col("_at").alias("bar_idx")).agg(*flags)

    # State by state, the bars on which a zone has it.
    steps = [(1, F.col("_from"), F.coalesce("_broken", "_end")), (3, F.col("_broken"), F.coalesce("_back", "_end")), (4, F.col("_back"), F.col("_end"))]
    spell = F.explode(F.array(*(F.struct(F.lit(n).alias("state"), a.alias("a"), b.alias("b")) for n, a, b in steps)))
    spells = zones.select(*keys, "_side", "_confirm", spell.alias("_s")).where("_s.a < _s.b")
    chunk = lambda c: F.floor(F.col(c) / size).cast("int")
    spells = spells.withColumn(CHUNK, F.explode(F.sequence(chunk("_s.a"), F.floor((F.col("_s.b") - 1) / size).cast("int"))))
    met = joined(spells, bars, [*keys, CHUNK]).where("bar_idx >= _s.a AND bar_idx < _s.b")
    best = {s: F.max(F.when(sign == other[s], F.struct("_s.state", "_confirm"))).alias(f"_best_{s}") for s in SIDES}
    states = met.groupBy(*keys, "bar_idx").agg(*best.values())

    rows = joined(joined(df, events, [*keys, "bar_idx"], "left"), states, [*keys, "bar_idx"], "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    width = F.coalesce(F.col("_wide_bull.width"), F.col("_wide_bear.width"))
    out = {f"ifvg_{s}": one(f"_inverted_{s}") for s in SIDES} | {"ifvg_width_atr": F.when(F.col("atr_14") > 0, width / F.col("atr_14"))}
    out |= {f"ifvg_{s}_{n}": one(f"_broken_{s}") for n in ("break", "candidate") for s in SIDES}
    out |= {f"ifvg_{s}_retest": one(f"_inverted_{s}") if require_retest else F.lit(0) for s in SIDES}
    out |= {f"ifvg_state_{s}": one(f"_best_{s}.state") for s in SIDES} | {f"ifvg_origin_idx_{s}": F.coalesce(F.col(f"_best_{s}._confirm"), F.lit(-1)).cast("int") for s in SIDES}
    return rows.withColumns(out).drop(CHUNK, *(f"_{x}_{s}" for x in ("inverted", "broken", "wide", "best") for s in SIDES))
