"""DuckDB SQL of the operators that keep a bounded list of zones, and of the full stack and what is built on it.

The full stack is a join of its layers. There the ATR is missing in its first bars, while the single operators' queries start it early;
`cold` makes the one out of the other.
"""

from __future__ import annotations

import re

from . import oracle
from .oracle import (
    BLOCKS, BREAKS, CAUSAL, DISPLACED, GAPS, LAG, PHASE_COLUMNS, PHASES, PIVOTS, RECURSIVE, SWINGS, TREND, ZONES, amd, flag, frame,
)

# Gaps of each side as a list from bar to bar, oldest first: a new one pushes the oldest of more than five out, a full one goes.
FILL_LISTS = """
, fs AS (SELECT instrument, side FROM (SELECT DISTINCT instrument FROM s), (VALUES ('u'), ('d')) AS sides(side)),
fl AS (
  SELECT instrument, side, -1 AS i, []::STRUCT(lo DOUBLE, hi DOUBLE, confirm BIGINT, fill DOUBLE, p DOUBLE)[] AS zones FROM fs
  UNION ALL
  SELECT instrument, side, i, list_transform(
      list_filter(kept, lambda z: z.p IS NULL OR z.p < 1),
      lambda z: {'lo': z.lo, 'hi': z.hi, 'confirm': z.confirm, 'fill': greatest(z.fill, coalesce(p_of(i, side, low, high, z), 0)), 'p': p_of(i, side, low, high, z)}
    )
  FROM (
    SELECT fl.instrument, fl.side, s.i, s.low, s.high,
      CASE WHEN zn.head IS NULL THEN fl.zones
        ELSE list_slice(list_append(list_filter(fl.zones, lambda z: z.p IS NULL OR z.p < 1), {'lo': zn.lo, 'hi': zn.hi, 'confirm': zn.confirm, 'fill': 0, 'p': NULL}), -5, -1) END AS kept
    FROM fl JOIN s ON s.instrument = fl.instrument AND s.i = fl.i + 1 LEFT JOIN zn ON zn.instrument = s.instrument AND zn.side = fl.side AND zn.head = s.i
  )
),
fv AS (SELECT *, list_filter(zones, lambda z: z.p IS NOT NULL) AS seen, list_filter(zones, lambda z: z.p < 1) AS alive FROM fl WHERE i >= 0),
fw AS (SELECT *, list_aggregate(list_transform(alive, lambda z: z.fill), 'max') AS best FROM fv),
fc AS (
  SELECT instrument, side, i, best, (i - list_filter(alive, lambda z: z.fill = best)[1].confirm)::DOUBLE AS age, len(list_filter(seen, lambda z: z.p > 0)) > 0 AS touched,
    len(list_filter(seen, lambda z: z.p > 0 AND z.p < 1)) > 0 AS part, len(list_filter(seen, lambda z: z.p >= 1)) > 0 AS whole
  FROM fw
)
""".replace("p_of(i, side, low, high, z)", "CASE WHEN i > z.confirm THEN least(greatest(CASE WHEN side = 'u' THEN z.hi - low ELSE high - z.lo END, 0) / (z.hi - z.lo), 1) END")

# Order blocks likewise, three of each side; a block that is broken goes.
RETEST_LISTS = """
, oz AS (
  SELECT instrument, i, 'u' AS side, open AS hi, low AS lo FROM oe WHERE u = 1 UNION ALL SELECT instrument, i, 'd', high, open FROM oe WHERE d = 1
), os AS (SELECT instrument, side FROM (SELECT DISTINCT instrument FROM s), (VALUES ('u'), ('d')) AS sides(side)),
ol AS (
  SELECT instrument, side, -1 AS i, []::STRUCT(lo DOUBLE, hi DOUBLE, i BIGINT, met BOOLEAN)[] AS zones, FALSE AS retest FROM os
  UNION ALL
  SELECT instrument, side, i,
    list_transform(
      list_filter(kept, lambda z: NOT (i > z.i AND CASE WHEN side = 'u' THEN low < z.lo ELSE high > z.hi END)),
      lambda z: {'lo': z.lo, 'hi': z.hi, 'i': z.i, 'met': z.met OR (i > z.i AND CASE WHEN side = 'u' THEN low <= z.hi ELSE high >= z.lo END)}
    ),
    len(list_filter(kept, lambda z: NOT z.met AND i > z.i AND CASE WHEN side = 'u' THEN low <= z.hi ELSE high >= z.lo END)) > 0
  FROM (
    SELECT ol.instrument, ol.side, s.i, s.low, s.high, CASE WHEN oz.i IS NULL THEN ol.zones ELSE list_slice(list_append(ol.zones, {'lo': oz.lo, 'hi': oz.hi, 'i': oz.i, 'met': FALSE}), -3, -1) END AS kept
    FROM ol JOIN s ON s.instrument = ol.instrument AND s.i = ol.i + 1 LEFT JOIN oz ON oz.instrument = s.instrument AND oz.side = ol.side AND oz.i = s.i
  )
)
"""

# Clusters as a list from swing to swing. Swings of a side are more than two bars apart, so twenty clusters are never live at once.
EQUALS = f"""
, qe AS (
  SELECT instrument, 'high' AS side, i, high AS price, atrx AS atr, row_number() OVER (PARTITION BY instrument ORDER BY i) AS n FROM sl WHERE sh = 1
  UNION ALL SELECT instrument, 'low', i, low, atrx, row_number() OVER (PARTITION BY instrument ORDER BY i) FROM sl WHERE sl = 1
), qr AS (
  SELECT instrument, side, n, i, 1 AS ids, 0 AS id, [{{'id': 0, 'prices': [price], 'first': i, 'last': i, 'level': price}}] AS clusters FROM qe WHERE n = 1
  UNION ALL
  SELECT instrument, side, n, i, CASE WHEN id IS NULL THEN ids + 1 ELSE ids END, coalesce(id, ids),
    CASE WHEN id IS NULL THEN list_append(live, {{'id': ids, 'prices': [price], 'first': i, 'last': i, 'level': price}})
      ELSE list_transform(live, lambda c: CASE WHEN c.id = id
        THEN {{'id': c.id, 'prices': list_append(c.prices, price), 'first': c.first, 'last': i, 'level': list_aggregate(list_append(c.prices, price), 'median')}} ELSE c END) END
  FROM (
    SELECT *, list_sort(list_transform(list_filter(live, lambda c: abs(price - c.level) <= CASE WHEN atr > 0 THEN 0.1 * atr ELSE 0 END), lambda c: {{'d': abs(price - c.level), 'id': c.id}}))[1].id AS id
    FROM (SELECT qe.*, qr.ids, list_filter(qr.clusters, lambda c: qe.i - c.last <= 50) AS live FROM qr JOIN qe ON qe.instrument = qr.instrument AND qe.side = qr.side AND qe.n = qr.n + 1)
  )
), qc AS (SELECT qr.*, list_filter(clusters, lambda c: c.id = qr.id)[1] AS c FROM qr),
qd AS (
  SELECT qc.instrument, qc.side, qc.i, id, len(c.prices) AS touches, c.level AS level, list_max(c.prices) - list_min(c.prices) AS width,
    CASE WHEN atr > 0 THEN (list_max(c.prices) - list_min(c.prices)) / atr END AS width_atr, (qc.i - c.first)::DOUBLE AS span
  FROM qc JOIN qe ON qe.instrument = qc.instrument AND qe.side = qc.side AND qe.i = qc.i WHERE len(c.prices) >= 2
), qf AS (SELECT *, touches / (1 + greatest(coalesce(width_atr, 0), 0)) * (1 + 0.1 * ln(1 + span)) AS score FROM qd)
"""


def equal_columns(name: str, x: str) -> str:
    out = [f"CAST({x}.i IS NOT DISTINCT FROM sl.i AS BIGINT) AS equal_{name}", f"coalesce({x}.touches, 0)::BIGINT AS equal_{name}_count"]
    out += [f"round({x}.{c}, 6) AS equal_{name}_{c}" for c in ("level", "width", "width_atr", "span", "score")]
    out += [f"CASE WHEN {x}.i = sl.i THEN 0.0::DOUBLE END AS equal_{name}_age", f"CAST({x}.i IS NOT NULL AS BIGINT) AS equal_{name}_active", f"CAST(CASE WHEN {x}.i = sl.i THEN {x}.id ELSE -1 END AS BIGINT) AS equal_{name}_cluster_id"]
    return ", ".join(out)


def fill_columns() -> str:
    sides = (("u", "bull"), ("d", "bear"))
    out = [f"CAST({x}.best IS NOT NULL AS BIGINT) AS fvg_active_{n}" for x, n in sides]
    out += [f"{f'round({c}, 6)' if c == 'best' else c} AS {n}" for c, n in (("best", "fvg_fill_pct"), ("age", "fvg_age"))]
    for x, n in sides:
        out += [f"round({x}.best, 6) AS fvg_fill_pct_{n}", f"{x}.age AS fvg_age_{n}", *(f"CAST({x}.{c} AS BIGINT) AS fvg_{m}_{n}" for c, m in (("touched", "touched"), ("part", "partial"), ("whole", "full"))), f"0::BIGINT AS fvg_invalid_{n}"]
    shared = "CASE WHEN u.best >= coalesce(d.best, -1) THEN u.{0} ELSE d.{0} END"
    return ", ".join(out).replace("round(best, 6) AS fvg_fill_pct,", f"round({shared.format('best')}, 6) AS fvg_fill_pct,").replace(" age AS fvg_age,", f" {shared.format('age')} AS fvg_age,")


SQL: dict[str, str] = {
    "fvg_fill": frame(RECURSIVE, PIVOTS + GAPS + ZONES + FILL_LISTS, recursive=True, select=f"SELECT s.instrument, t, {fill_columns()} FROM s JOIN fc u ON u.instrument = s.instrument AND u.i = s.i AND u.side = 'u' JOIN fc d ON d.instrument = s.instrument AND d.i = s.i AND d.side = 'd'"),
    "ob_mitigation": frame(RECURSIVE, PIVOTS + BLOCKS + RETEST_LISTS, recursive=True, select="""SELECT s.instrument, t, CAST(len(u.zones) > 0 AS BIGINT) AS ob_unmitigated_bull, CAST(len(d.zones) > 0 AS BIGINT) AS ob_unmitigated_bear, CAST(u.retest OR d.retest AS BIGINT) AS ob_first_retest
      FROM s JOIN ol u ON u.instrument = s.instrument AND u.i = s.i AND u.side = 'u' JOIN ol d ON d.instrument = s.instrument AND d.i = s.i AND d.side = 'd'"""),
    "equal_hl": frame(RECURSIVE, SWINGS + EQUALS, recursive=True, select=f"""SELECT sl.instrument, t, {equal_columns('highs', 'h')}, {equal_columns('lows', 'l')}
      FROM sl ASOF LEFT JOIN (SELECT * FROM qf WHERE side = 'high') h ON h.instrument = sl.instrument AND sl.i >= h.i ASOF LEFT JOIN (SELECT * FROM qf WHERE side = 'low') l ON l.instrument = sl.instrument AND sl.i >= l.i"""),
}


def cold(sql: str) -> str:
    """The query with an ATR that is missing until its window is full."""
    return sql.replace(", h10, atr, atrx, adx,", ", h10, atr, atr AS atrx, adx,")


def exact(sql: str) -> str:
    """The query without rounding, for what is computed from its columns."""
    return re.sub(r", 6\) AS (\w+)", r", 15) AS \1", sql)


# The layers of the full stack and the columns each gives.
LAYERS: dict[str, str] = {
    name: cold({**oracle.SQL, **SQL}[name])
    for name in (
        "prev_day", "prev_week", "asian_session", "session", "time_features", "volume_ratio", "key_volume_flags", "candle_delta_proxy", "vsa", "wick_ratio", "bb_width", "emas", "adx", "rsi", "macd", "body_ratio", "swings", "trend_state", "bos", "choch",
        "displacement_candle", "rolling_atr_ratio", "liquidity_sweep", "amd_features", "order_blocks", "fvg", "fvg_fill", "ifvg", "ob_mitigation", "equal_hl", "volume_profile", "avwap_from_last_swing", "regime",
    )
}
LAYERS |= {
    "atr_pct": re.sub(r"round\(atr, 6\) AS atr_14, ", "", oracle.SQL["atr"]),
    "divergence": re.sub(r"round\(rsi, 6\) AS rsi_14, ", "", oracle.SQL["rsi_divergence"]),
    "phases": cold(frame(RECURSIVE + DISPLACED + amd() + PHASES, recursive=True, select=f"SELECT instrument, t, {PHASE_COLUMNS} FROM sx")),
    "prices": frame(select="SELECT instrument, t, CAST(i AS BIGINT) AS bar_idx, open, high, low, close, CAST(volume AS DOUBLE) AS volume, 0::BIGINT AS near_round_number FROM b"),
}


def joined(*names: str, digits: bool = True) -> str:
    """Those layers in one table; digits: rounded."""
    parts = [f"({LAYERS[n] if digits else exact(LAYERS[n])})" for n in ("prices", *names)]
    return "SELECT * FROM " + " JOIN ".join(f"{p} USING (instrument, t)" if i else p for i, p in enumerate(parts))


def built(*names: str, select: str) -> str:
    """A query over those layers, as table `f`."""
    return f"WITH f AS MATERIALIZED ({joined(*names, digits=False)}) {select}"


def any_of(condition: str, low: int, high: int) -> str:
    """Whether a condition holds on a bar of the frame."""
    side = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}" if n else "CURRENT ROW"
    return f"coalesce(bool_or({condition}) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN {side(low)} AND {side(high)}), FALSE)"


EVENTS = (
    "swing_high", "swing_low", "bos_bull", "bos_bear", "choch_bull", "choch_bear", "fvg_bull", "fvg_bear", "ifvg_bull", "ifvg_bear", "ob_bull", "ob_bear", "sweep_high", "sweep_low", "equal_highs", "equal_lows", "displacement_candle",
    "amd_is_manipulation",
)
_EVENT_ROWS = " UNION ALL ".join(f"SELECT instrument, t, '{e}' AS detector, close FROM f WHERE {e} = 1" for e in EVENTS)
_EVENT_LAYERS = ("swings", "bos", "choch", "fvg", "ifvg", "order_blocks", "liquidity_sweep", "equal_hl", "displacement_candle", "phases")

_GAP = "fvg_bull = 1 OR fvg_bear = 1"
_LOW, _HIGH = "coalesce(fvg_bull_low, fvg_bear_low)", "coalesce(fvg_bull_high, fvg_bear_high)"
_INSIDE = [f"vp_{v} BETWEEN {_LOW} AND {_HIGH}" for v in ("poc", "vah", "val")]
_AWAY = ", ".join(f"CASE WHEN {i} THEN 0 ELSE least(abs(vp_{v} - {_LOW}), abs(vp_{v} - {_HIGH})) END" for v, i in zip(("poc", "vah", "val"), _INSIDE, strict=True))
_BROKEN = "CASE WHEN bos_bull = 1 THEN last_swing_high ELSE last_swing_low END"
_SWEPT = "coalesce(sweep_level_high, sweep_level_low)"
_BEFORE = "OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _at(zone: str, live: str) -> str:
    return f"({_SWEPT} >= last_value({zone}_low IGNORE NULLS) {_BEFORE} AND {_SWEPT} <= last_value({zone}_high IGNORE NULLS) {_BEFORE} AND {live} = 1)"


def _phase_columns() -> str:
    made = "ifvg_bull = 1 OR ifvg_bear = 1"
    wick = "CASE WHEN ifvg_bull = 1 THEN least(open, close) - low ELSE high - greatest(open, close) END > abs(close - open)"
    way = "CASE WHEN ifvg_bull = 1 THEN close > open AND rsi_14 > 45 ELSE close < open AND rsi_14 < 55 END"
    return ", ".join([
        flag(f"({made}) AND {any_of('amd_is_manipulation = 1', -20, 0)}", "ifvg_after_manipulation"), flag(f"({made}) AND {any_of('rsi_div_bullish = 1 OR rsi_div_bearish = 1', -20, 0)}", "ifvg_with_divergence"),
        flag(f"({made}) AND {wick} AND {way} AND vol_below_avg = 1", "ifvg_rejection"),
    ])


# Two timeframes: each a query of its own, joined by the bars' times. A bar is known when it has closed.
_H4_SWEEPS = frame(RECURSIVE, SWINGS + oracle.sweeps("sl", "lh", "lhi", "ll", "lli"), recursive=True, seconds=14400, select="SELECT instrument, t, CAST(coalesce(qh, FALSE) AS BIGINT) - CAST(coalesce(ql, FALSE) AS BIGINT) AS sweep_side FROM sy WHERE qh OR ql")
_M15_CHANGES = frame(
    RECURSIVE, SWINGS + TREND + BREAKS.format(of="tt") + f", ch AS (SELECT *, lag(st) {LAG} AS pst FROM bs)", recursive=True, seconds=900,
    select="SELECT instrument, t, CASE WHEN bb = 1 AND pst = -1 THEN 1 ELSE -1 END AS side FROM ch WHERE ((bb = 1 AND pst = -1) OR (bx = 1 AND pst = 1)) AND abs(close - open) >= 0.6 * (high - low)",
)
_M15_REJECTIONS = frame(seconds=900, select="""SELECT instrument, t, 1 AS side FROM b WHERE least(open, close) - low > abs(close - open) AND close > open
  UNION ALL SELECT instrument, t, -1 FROM b WHERE high - greatest(open, close) > abs(close - open) AND close < open""")
_H1_BLOCKS = frame(RECURSIVE, PIVOTS + BLOCKS + RETEST_LISTS, recursive=True, select="""SELECT s.instrument, s.t, CASE WHEN o.side = 'u' THEN 1 ELSE -1 END AS side FROM s JOIN ol o ON o.instrument = s.instrument AND o.i = s.i WHERE o.retest
  QUALIFY count(*) OVER (PARTITION BY s.instrument, s.t) = 1""")
_H1_INVERSIONS = f"SELECT instrument, t, CASE WHEN ifvg_bull = 1 THEN 1 ELSE -1 END AS side FROM ({oracle.SQL['ifvg']}) WHERE ifvg_bull + ifvg_bear = 1"


def next_below(events: str, hits: str, seconds: int, within: int, name: str, columns: str, on: str = "TRUE") -> str:
    """Events with the first hit on a lower timeframe from their bar's close on, if it comes soon enough."""
    return f"""SELECT e.instrument, e.t, {columns}, min(h.t) AS {name} FROM ({events}) e LEFT JOIN ({hits}) h
      ON h.instrument = e.instrument AND h.t >= e.t + {seconds} AND h.t - (e.t + {seconds}) <= {within} AND {on} GROUP BY ALL"""


# The last gap on 4-hour bars, known when the bar after it closes, until a later bar has gone through it; and the daily trend.
_H4_GAPS = frame(RECURSIVE, PIVOTS + GAPS + f""", gl AS (
    SELECT instrument, t, i, low, high, lag(CASE WHEN u THEN h0 WHEN d THEN h2 END) {LAG} AS lo, lag(CASE WHEN u THEN l2 WHEN d THEN l0 END) {LAG} AS hi, lag(CASE WHEN u THEN 1 WHEN d THEN -1 END) {LAG} AS side FROM gb
  ), gn AS (SELECT *, max(CASE WHEN side IS NOT NULL THEN i END) OVER (PARTITION BY instrument ORDER BY i) AS told FROM gl),
  gz AS (SELECT n.instrument, n.t, z.lo, z.hi, z.side, (SELECT bool_or(CASE WHEN z.side = 1 THEN x.low <= z.lo ELSE x.high >= z.hi END) FROM gn x WHERE x.instrument = n.instrument AND x.i > n.told AND x.i <= n.i) AS gone
    FROM gn n LEFT JOIN gn z ON z.instrument = n.instrument AND z.i = n.told)""", recursive=True, seconds=14400,
  select="SELECT instrument, t + 14400 AS known, CASE WHEN gone THEN NULL ELSE lo END AS lo, CASE WHEN gone THEN NULL ELSE hi END AS hi, CASE WHEN gone THEN NULL ELSE side END AS side FROM gz")
_DAILY_TREND = frame(CAUSAL + TREND, recursive=True, seconds=86400, select="SELECT instrument, t + 86400 AS known, CAST(st AS BIGINT) AS bias FROM tt")

SQL |= {
    "setup_confirmed": next_below(_H4_SWEEPS, _M15_CHANGES, 14400, 86400, "confirmed_t", "sweep_side", "h.side = -e.sweep_side"),
    "setup_block_rejection": next_below(_H1_BLOCKS, _M15_REJECTIONS, 3600, 7200, "rejected_t", "CAST(e.side AS BIGINT) AS side", "h.side = e.side"),
    "setup_inversion_rejection": next_below(_H1_INVERSIONS, _M15_REJECTIONS, 3600, 7200, "rejected_t", "CAST(e.side AS BIGINT) AS side", "h.side = e.side"),
    "setup_zone_entry": f"""SELECT b.instrument, b.t, z.lo AS htf_zone_low, z.hi AS htf_zone_high, CAST(z.side AS BIGINT) AS htf_zone_side, d.bias AS htf_bias, {flag('b.low <= z.hi AND b.high >= z.lo', 'in_htf_zone')},
      {flag('b.low <= z.hi AND b.high >= z.lo AND d.bias = z.side', 'zone_entry')} FROM ({frame(select='SELECT instrument, t, low, high FROM b')}) b
      ASOF LEFT JOIN ({_H4_GAPS}) z ON z.instrument = b.instrument AND b.t >= z.known ASOF LEFT JOIN ({_DAILY_TREND}) d ON d.instrument = b.instrument AND b.t >= d.known""",
    "full_pipeline": joined(*(n for n in LAYERS if n != "prices")),
    "q_detector_events": built(*_EVENT_LAYERS, select=_EVENT_ROWS),
    "setup_fvg": built("fvg", "fvg_fill", "liquidity_sweep", "volume_ratio", "volume_profile", "choch", "bos", "swings", "emas", select=f"""SELECT instrument, t, {flag(f"({_GAP}) AND {any_of('sweep_high = 1 OR sweep_low = 1', -5, -1)}", 'sweep_preceded_fvg')},
      round(CASE WHEN {_GAP} THEN vol_ratio END, 6) AS fvg_creation_volume_ratio, round(CASE WHEN ({_GAP}) AND atr_14 > 0 THEN least({_AWAY}) / atr_14 END, 6) AS fvg_vp_distance_atr, {flag(f"({_GAP}) AND ({' OR '.join(_INSIDE)})", 'fvg_at_vp_level')},
      {flag(f"fvg_fill_pct > 0 AND {any_of('choch_bull = 1 OR choch_bear = 1', 0, 2)}", 'choch_at_fvg_retest')}, CASE WHEN fvg_fill_pct BETWEEN 0.2 AND 0.5 THEN 'optimal' WHEN fvg_fill_pct > 0.7 THEN 'absorbed' WHEN fvg_fill_pct > 0 THEN 'other' END AS retest_quality,
      {flag(f"(bos_bull = 1 OR bos_bear = 1) AND least({', '.join(f'abs({_BROKEN} - vp_{v})' for v in ('poc', 'vah', 'val'))}) <= 0.3 * atr_14", 'bos_at_vp_level')} FROM f"""),
    "setup_blocks": built("order_blocks", "fvg", "ob_mitigation", "rolling_atr_ratio", select=f"""SELECT instrument, t, {flag(f"(ob_bull = 1 OR ob_bear = 1) AND {any_of(_GAP, 1, 3)}", 'ob_has_fvg')},
      {flag('ob_first_retest = 1 AND atr_ratio_rolling < 1', 'ob_retest_decelerating')} FROM f"""),
    "setup_sweeps": built("liquidity_sweep", "divergence", "key_volume_flags", "equal_hl", "session", "fvg", "fvg_fill", "order_blocks", "ob_mitigation", select=f"""SELECT instrument, t, {flag('(sweep_high = 1 AND rsi_div_bearish = 1) OR (sweep_low = 1 AND rsi_div_bullish = 1)', 'sweep_with_divergence')},
      {flag('(sweep_high = 1 OR sweep_low = 1) AND vol_below_avg = 1', 'sweep_on_low_volume')}, CASE WHEN sweep_high = 1 THEN equal_highs_count WHEN sweep_low = 1 THEN equal_lows_count END AS sweep_prior_tests,
      {flag('(sweep_high = 1 OR sweep_low = 1) AND (london_open = 1 OR ny_open = 1)', 'sweep_in_session_open')}, {flag(f"{_at('fvg_bull', 'fvg_active_bull')} OR {_at('fvg_bear', 'fvg_active_bear')}", 'sweep_at_fvg')},
      {flag(f"{_at('ob_bull', 'ob_unmitigated_bull')} OR {_at('ob_bear', 'ob_unmitigated_bear')}", 'sweep_at_ob')} FROM f"""),
    "setup_phases": built("ifvg", "phases", "divergence", "rsi", "key_volume_flags", select=f"SELECT instrument, t, {_phase_columns()} FROM f"),
}

SQL["resumed_stack"] = joined("emas", "atr_pct", "adx", "rsi", "macd", "bb_width", "body_ratio", "volume_ratio", "key_volume_flags", "candle_delta_proxy", "vsa", "wick_ratio", "displacement_candle", "rolling_atr_ratio").replace("SELECT *", "SELECT * EXCLUDE (near_round_number)", 1)

# Setups as sequences, each stage the first event that fits after the one before.
_CHANGES = SWINGS + TREND + BREAKS.format(of="tt") + f", ch AS (SELECT *, lag(st) {LAG} AS pst FROM bs), cs AS (SELECT *, CASE WHEN bb = 1 AND pst = -1 THEN 1 WHEN bx = 1 AND pst = 1 THEN -1 END AS side FROM ch)"
_H1_CHANGES = frame(RECURSIVE, _CHANGES, recursive=True, select="SELECT instrument, t + 3600 AS at, side FROM cs WHERE side IS NOT NULL")
_M15_SIDED = frame(RECURSIVE, _CHANGES, recursive=True, seconds=900, select="SELECT instrument, t AS at, side FROM cs WHERE side IS NOT NULL AND abs(close - open) >= 0.6 * (high - low)")
_M15_WICKS = frame(RECURSIVE, recursive=True, seconds=900, select=f"""SELECT *, CASE WHEN side = 1 THEN low ELSE greatest(open, close) END AS w0, CASE WHEN side = 1 THEN least(open, close) ELSE high END AS w1 FROM (
  SELECT instrument, t AS at, open, high, low, close, rsi, volume > av AS loud, volume < av AS quiet, hist - lag(hist) {LAG} AS turn,
    CASE WHEN least(open, close) - low > abs(close - open) AND close > open THEN 1 WHEN high - greatest(open, close) > abs(close - open) AND close < open THEN -1 END AS side
  FROM (SELECT *, {oracle.guarded('avg', 'volume', 20)} AS av FROM s)) WHERE side IS NOT NULL""")
_H1_INVERTED = frame(RECURSIVE, PIVOTS + GAPS + oracle.ZONES, recursive=True, select="SELECT zr.instrument, CASE WHEN side = 'u' THEN -1 ELSE 1 END AS side, lo, hi, t + 3600 AS at FROM zr JOIN s ON s.instrument = zr.instrument AND s.i = rt")
_RETEST = "list_filter(kept, lambda z: NOT z.met AND i > z.i AND CASE WHEN side = 'u' THEN low <= z.hi ELSE high >= z.lo END)"
_RETESTED = RETEST_LISTS.replace("FALSE AS retest FROM os", "FALSE AS retest, NULL::STRUCT(lo DOUBLE, hi DOUBLE, i BIGINT, met BOOLEAN) AS zone FROM os").replace(f"len({_RETEST}) > 0", f"len({_RETEST}) > 0, {_RETEST}[-1]")
_H1_RETESTED = frame(RECURSIVE, PIVOTS + BLOCKS + _RETESTED + f", ra AS (SELECT *, CASE WHEN i >= 9 THEN avg(atrx) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(atrx) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END AS ratio FROM s)", recursive=True,
  select="SELECT ol.instrument, CASE WHEN ol.side = 'u' THEN 1 ELSE -1 END AS side, zone.lo AS lo, zone.hi AS hi, t + 3600 AS at FROM ol JOIN ra ON ra.instrument = ol.instrument AND ra.i = ol.i WHERE retest AND ratio < 1")
_H1_TIMELY = frame(RECURSIVE, SWINGS + oracle.sweeps("sl", "lh", "lhi", "ll", "lli") + f", th AS (SELECT *, {oracle.HOUR} AS hr FROM sy WHERE qh OR ql)", recursive=True, select="SELECT instrument, t + 3600 AS at, unnest(CASE WHEN qh AND ql THEN [1, -1] WHEN ql THEN [1] ELSE [-1] END) AS side FROM th WHERE hr IN (8, 9, 13, 14)")
SQL |= {
    "setup_inversion_entry": f"""WITH a AS (SELECT DISTINCT * FROM ({_H1_INVERTED})), b AS (SELECT a.*, min(c.at) AS changed FROM a LEFT JOIN ({_H1_CHANGES}) c ON c.instrument = a.instrument AND c.side = a.side AND c.at BETWEEN a.at AND a.at + 432000 GROUP BY ALL)
      SELECT b.instrument, CAST(b.side AS BIGINT) AS side, round(lo, 6) AS zone_low, round(hi, 6) AS zone_high, b.at AS inverted_t, changed AS changed_t, min(e.at) AS entry_t FROM b LEFT JOIN ({_M15_WICKS}) e ON e.instrument = b.instrument AND e.side = b.side AND e.at BETWEEN changed AND changed + 172800
        AND w0 <= hi AND w1 >= lo AND quiet AND CASE WHEN e.side = 1 THEN rsi > 45 AND close > hi ELSE rsi < 55 AND close < lo END GROUP BY b.instrument, b.side, lo, hi, b.at, changed""",
    "setup_block_entry": f"""SELECT a.instrument, CAST(a.side AS BIGINT) AS side, round(lo, 6) AS zone_low, round(hi, 6) AS zone_high, a.at AS retest_t, min(e.at) AS entry_t FROM (SELECT DISTINCT * FROM ({_H1_RETESTED})) a LEFT JOIN ({_M15_WICKS}) e ON e.instrument = a.instrument AND e.side = a.side AND e.at BETWEEN a.at AND a.at + 172800
        AND w0 <= hi AND w1 >= lo AND loud AND turn * e.side > 0 GROUP BY a.instrument, a.side, lo, hi, a.at""",
    "setup_session_entry": f"""SELECT a.instrument, CAST(a.side AS BIGINT) AS side, NULL::DOUBLE AS zone_low, NULL::DOUBLE AS zone_high, a.at AS sweep_t, min(c.at) AS change_t FROM ({_H1_TIMELY}) a LEFT JOIN ({_M15_SIDED}) c ON c.instrument = a.instrument AND c.side = a.side AND c.at BETWEEN a.at AND a.at + 86400 GROUP BY ALL""",
}

_STREAMED = "round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS volume"
_FINAL = "(SELECT epoch(max(ts)) - 3600 FROM events)"
SQL |= {
    "stream_hops": f"""SELECT instrument, t, {_STREAMED} FROM (SELECT event_type AS instrument, ts, event_id, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 - k * 3600 AS t FROM events, range(4) AS hours(k)) WHERE t + 14400 <= {_FINAL} GROUP BY ALL""",
    "stream_sessions": f"""SELECT instrument, CAST(floor(epoch(min(ts))) AS BIGINT) AS t, CAST(floor(epoch(max(ts)) + 1800) AS BIGINT) AS ends_t, {_STREAMED} FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_type AS instrument, ts, event_id, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events)
      ) GROUP BY instrument, run HAVING epoch(max(ts)) + 1800 <= {_FINAL}""",
    "stream_two_timeframes": f"SELECT l.instrument, l.t, round(l.close, 6) AS close, round(h.close, 6) AS htf_close FROM ({frame(select='SELECT instrument, t, close FROM b')}) l JOIN ({frame(seconds=14400, select='SELECT instrument, t, close FROM b')}) h ON h.instrument = l.instrument AND l.t >= h.t + 14400 AND l.t < h.t + 28800",
    "stream_zones": f"SELECT * FROM ({SQL['fvg_fill']}) WHERE t <= (SELECT max(t) - 3600 FROM ({SQL['fvg_fill']}))",
}

_NAME = "CASE instrument WHEN 'click' THEN 'XAU_USD' WHEN 'purchase' THEN 'USOIL' WHEN 'view' THEN 'EUR_USD' ELSE 'USD_JPY' END"
_BY_NAME = f"(SELECT instrument, t, open / k AS open, close / k AS close, atrx / k AS atr, volume, name, CASE name WHEN 'XAU_USD' THEN 50 WHEN 'USOIL' THEN 5 END AS step FROM (SELECT *, {_NAME} AS name, CASE WHEN {_NAME} = 'USOIL' THEN 10.0::DOUBLE ELSE 1 END AS k FROM s))"
SQL |= {
    "q_latest_snapshot": built("volume_profile", "prev_day", "prev_week", "regime", select="""SELECT instrument, t, round(close, 6) AS close, round(vp_poc, 6) AS vp_poc, round(vp_vah, 6) AS vp_vah, round(vp_val, 6) AS vp_val, round(vp_poc_distance_atr, 6) AS vp_poc_distance_atr,
      prev_day_high, prev_day_low, prev_week_high, prev_week_low, near_round_number, regime, regime_label FROM f QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY t DESC) = 1"""),
    "round_numbers_named": frame(RECURSIVE, recursive=True, select=f"SELECT instrument, t, {flag('least(least(close % step, step / 2.0), step - least(close % step, step / 2.0)) < 0.3 * atr', 'near_round_number')} FROM {_BY_NAME}"),
    "setup_costs_spread": frame(RECURSIVE, recursive=True, select=f"""SELECT instrument, t, round(cost, 6) AS cost, round(close + side - side * cost, 6) AS target_net, round(close - side + side * cost, 6) AS stop_net FROM (
      SELECT *, CASE WHEN close >= open THEN 1 ELSE -1 END AS side, CASE WHEN volume % 3 > 0 THEN volume * 10 / 1000.0::DOUBLE ELSE CASE name WHEN 'XAU_USD' THEN 0.5 WHEN 'USOIL' THEN 0.07 WHEN 'EUR_USD' THEN 0.0002 ELSE 0.02 END END AS cost FROM {_BY_NAME})"""),
}
