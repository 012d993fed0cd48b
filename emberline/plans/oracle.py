"""DuckDB SQL that computes the queries' results in its own way, for checking them."""

from __future__ import annotations

BASE = """
ticks AS (
  SELECT {instrument} AS instrument, ts, event_id, value, CAST(round(value * 100) AS BIGINT) - 4963 AS move FROM events
), walk AS (
  SELECT instrument, ts, event_id, value,
    (200000 + floor(sum(move) OVER (PARTITION BY instrument ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 50.0::DOUBLE)) / 100.0::DOUBLE AS price
  FROM ticks
), candles AS (
  SELECT instrument, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds} AS t, arg_min({price}, (ts, event_id)) AS open, max({price}) AS high, min({price}) AS low,
    arg_max({price}, (ts, event_id)) AS close, count(*) AS volume
  FROM walk GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t) - 1 AS i, lag(close) OVER (PARTITION BY instrument ORDER BY t) AS pc,
    lag(high) OVER (PARTITION BY instrument ORDER BY t) AS ph, lag(low) OVER (PARTITION BY instrument ORDER BY t) AS pl,
    CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END AS uw,
    CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END AS lw,
    CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END AS bf
  FROM candles
)
"""


def base(seconds: int = 3600, instrument: str = "event_type", price: str = "price") -> str:
    return BASE.format(seconds=seconds, instrument=instrument, price=price)


# The recursive smoothers, one row after the other. Sums serve as seeds.
RECURSIVE = """
x AS (
  SELECT instrument, i, t, open, high, low, close, volume, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr0,
    close - pc AS ch, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS dp, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dm
  FROM b
), r AS (
  SELECT instrument, i, close AS e20, close AS e50, close AS e200, close AS e12, close AS e26, 0.0::DOUBLE AS sig, high AS h10, tr AS satr, tr0 AS atrx, NULL::DOUBLE AS atr,
    0.0::DOUBLE AS sg, 0.0::DOUBLE AS sl, NULL::DOUBLE AS g, NULL::DOUBLE AS l, tr AS wt, dp::DOUBLE AS wp, dm::DOUBLE AS wm, 0.0::DOUBLE AS sdx, NULL::DOUBLE AS adx
  FROM x WHERE i = 0
  UNION ALL
  SELECT instrument, i, e20, e50, e200, e12, e26, sig, h10, satr, atrx, atr, sg, sl, g, l, wt, wp, wm, CASE WHEN i < 14 THEN sdx + dx ELSE sdx END AS sdx,
    CASE WHEN i < 13 THEN NULL WHEN i = 13 THEN (sdx + dx) / 14 ELSE adx * 13 / 14 + dx / 14 END AS adx
  FROM (
    SELECT *, CASE WHEN di_p + di_m > 0 THEN abs(di_p - di_m) / (di_p + di_m) * 100 ELSE 0 END AS dx FROM (
      SELECT *, CASE WHEN i >= 13 AND wt > 0 THEN 100 * wp / wt ELSE 0 END AS di_p, CASE WHEN i >= 13 AND wt > 0 THEN 100 * wm / wt ELSE 0 END AS di_m FROM (
        SELECT x.instrument, x.i, r.e20 + (x.close - r.e20) * 2 / 21 AS e20, r.e50 + (x.close - r.e50) * 2 / 51 AS e50, r.e200 + (x.close - r.e200) * 2 / 201 AS e200,
          r.e12 + (x.close - r.e12) * 2 / 13 AS e12, r.e26 + (x.close - r.e26) * 2 / 27 AS e26,
          r.sig + ((r.e12 + (x.close - r.e12) * 2 / 13) - (r.e26 + (x.close - r.e26) * 2 / 27) - r.sig) * 2 / 10 AS sig, r.h10 + (x.high - r.h10) * 2 / 11 AS h10,
          r.satr + x.tr AS satr, CASE WHEN x.i < 14 THEN (r.atrx * x.i + x.tr0) / (x.i + 1) ELSE r.atrx * 13 / 14 + x.tr0 / 14 END AS atrx,
          CASE WHEN x.i < 13 THEN NULL WHEN x.i = 13 THEN (r.satr + x.tr) / 14 ELSE r.atr * 13 / 14 + x.tr / 14 END AS atr,
          r.sg + greatest(x.ch, 0) AS sg, r.sl + greatest(-x.ch, 0) AS sl,
          CASE WHEN x.i < 14 THEN NULL WHEN x.i = 14 THEN (r.sg + greatest(x.ch, 0)) / 14 ELSE r.g * 13 / 14 + greatest(x.ch, 0) / 14 END AS g,
          CASE WHEN x.i < 14 THEN NULL WHEN x.i = 14 THEN (r.sl + greatest(-x.ch, 0)) / 14 ELSE r.l * 13 / 14 + greatest(-x.ch, 0) / 14 END AS l,
          CASE WHEN x.i < 14 THEN r.wt + x.tr ELSE r.wt - r.wt / 14 + x.tr END AS wt, CASE WHEN x.i < 14 THEN r.wp + x.dp ELSE r.wp - r.wp / 14 + x.dp END AS wp,
          CASE WHEN x.i < 14 THEN r.wm + x.dm ELSE r.wm - r.wm / 14 + x.dm END AS wm, r.sdx, r.adx
        FROM r JOIN x ON x.instrument = r.instrument AND x.i = r.i + 1
      )
    )
  )
), s AS (
  SELECT x.*, e20, e50, e200, e12 - e26 AS line, e12 - e26 - sig AS hist, h10, atr, atrx, adx,
    CASE WHEN g IS NULL OR (g = 0 AND l = 0) THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi, uw, lw, bf
  FROM x JOIN r USING (instrument, i) JOIN b USING (instrument, i)
)
"""

# Symmetric swings over three bars, as bars know them when they are confirmed.
SWINGS = """
sw AS (
  SELECT *, CASE WHEN i >= 3 AND n3 = 3 AND high >= hb AND high >= ha AND (high > hb OR high > ha) THEN 1 ELSE 0 END AS sh, CASE WHEN i >= 3 AND n3 = 3 AND low <= lb AND low <= la AND (low < lb OR low < la) THEN 1 ELSE 0 END AS sl
  FROM (
    SELECT *, max(high) OVER p AS hb, max(high) OVER f AS ha, min(low) OVER p AS lb, min(low) OVER f AS la, count(*) OVER f AS n3 FROM s
    WINDOW p AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)
  )
), sl AS (
  SELECT *, max(CASE WHEN sh = 1 THEN i END) OVER d AS lhi, max(CASE WHEN sl = 1 THEN i END) OVER d AS lli, arg_max(CASE WHEN sh = 1 THEN high END, CASE WHEN sh = 1 THEN i END) OVER d AS lh, arg_max(CASE WHEN sl = 1 THEN low END, CASE WHEN sl = 1 THEN i END) OVER d AS ll
  FROM sw WINDOW d AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)
)
"""


def frame(*parts: str, select: str, recursive: bool = False, **options: object) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([base(**options), *parts])} {select}"


def over(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


LAG = "OVER (PARTITION BY instrument ORDER BY i)"


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def r2(expression: str, name: str) -> str:
    """Running sums of squares differ by their order in the last digits."""
    return f"round({expression}, 2) AS {name}"


def flag(condition: str, name: str) -> str:
    return f"CAST(coalesce({condition}, FALSE) AS BIGINT) AS {name}"


def guarded(function: str, of: str, n: int) -> str:
    return f"CASE WHEN count({of}) {over(n)} = {n} THEN {function}({of}) {over(n)} END"


def rank(of: str, n: int) -> str:
    """Average rank in percent of the last of n values."""
    of = f"round({of}, 10)"
    values = f"list({of}) {over(n)}"
    return f"CASE WHEN count({of}) {over(n)} = {n} THEN (len(list_filter({values}, lambda v: v < {of})) + (len(list_filter({values}, lambda v: v = {of})) + 1) / 2.0::DOUBLE) / {n} * 100 END"


def smoothed(columns: str) -> str:
    return frame(RECURSIVE, recursive=True, select=f"SELECT instrument, t, {columns} FROM s")


def swinging(columns: str, extra: str = "", of: str = "sl") -> str:
    return frame(RECURSIVE, SWINGS + extra, recursive=True, select=f"SELECT instrument, t, {columns} FROM {of}")


PRICES = "open, high, low, close"
EMAS = ", ".join([r(f"e{p}", f"ema_{p}") + ", " + r(f"(e{p} - lag(e{p}, 3) {LAG}) / atr", f"ema_{p}_slope") + ", " + flag(f"close > e{p}", f"price_above_ema_{p}") for p in (20, 50, 200)] + [flag("e20 > e50", "ema_20_above_50"), flag("e50 > e200", "ema_50_above_200")])
HOUR = "CAST(floor(t / 3600) AS BIGINT) % 24"
DAY = "CAST(floor(t / 86400) AS BIGINT)"
BODY = "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END"
VOLUME = f"(volume / ({guarded('avg', 'volume', 20)}))"

SQL: dict[str, str] = {
    "bars_hourly": frame(select=f"SELECT instrument, t, {PRICES}, volume FROM candles"),
    "bars_dense": frame(seconds=900, instrument="'ALL'", select=f"SELECT instrument, t, {PRICES}, volume FROM candles"),
    "bars_daily": """SELECT l_returnflag AS instrument, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) * 86400 AS t, round(arg_min(l_extendedprice, (l_orderkey, l_linenumber)), 6) AS open, round(max(l_extendedprice), 6) AS high,
      round(min(l_extendedprice), 6) AS low, round(arg_max(l_extendedprice, (l_orderkey, l_linenumber)), 6) AS close, count(*) AS volume FROM lineitem GROUP BY ALL""",
    "bars_normalised": frame(select=f"SELECT instrument, t, {PRICES}, volume FROM candles"),
    "moving_averages": frame(select=f"""SELECT instrument, t, {r(guarded('avg', 'close', 10), 'sma_10')}, {r(f"({guarded('avg', 'close', 20)}) - 2 * stddev_samp(close) {over(20)}", 'bb_low')}, {r(guarded('avg', 'close', 20), 'bb_middle')},
      {r(f"({guarded('avg', 'close', 20)}) + 2 * stddev_samp(close) {over(20)}", 'bb_high')} FROM b"""),
    "emas": smoothed(f"{EMAS}, {r('atr', 'atr_14')}"),
    "ema_of_high": smoothed(r("h10", "ema_10")),
    "atr": smoothed(f"{r('atr', 'atr_14')}, {r(rank('atr', 50), 'atr_pct_50')}"),
    "atr_warm": smoothed(r("atrx", "atr_14")),
    "adx": smoothed(f"{r('adx', 'adx_14')}, {flag('adx > 20', 'adx_above_20')}, {flag('adx > 25', 'adx_above_25')}, {flag('adx > 40', 'adx_above_40')}, {r(f'adx - lag(adx, 3) {LAG}', 'adx_delta_3')}"),
    "rsi": smoothed(f"{r('rsi', 'rsi_14')}, {flag('rsi > 50', 'rsi_above_50')}, {flag('rsi > 70', 'rsi_above_70')}, {flag('rsi < 30', 'rsi_below_30')}, {r(f'rsi - lag(rsi, 3) {LAG}', 'rsi_delta_3')}"),
    "macd": smoothed(f"{r('hist', 'macd_hist')}, {flag('hist > 0', 'macd_hist_positive')}, {flag(f'abs(hist) > abs(lag(hist) {LAG})', 'macd_hist_expanding')}, {r(f'hist - lag(hist) {LAG}', 'macd_hist_delta')}"),
    "bb_width": frame(f"w AS (SELECT *, CASE WHEN i >= 19 THEN 4 * stddev_samp(close) {over(20)} / avg(close) {over(20)} END AS bw FROM b), q AS (SELECT *, {rank('bw', 50)} AS pct FROM w)",
                      select=f"SELECT instrument, t, {r('bw', 'bb_width')}, {r('pct', 'bb_width_pct_50')}, {flag('pct < 30', 'bb_width_below_30')}, {flag('pct < 40', 'bb_width_below_40')} FROM q"),
    "body_ratio": frame(select=f"SELECT instrument, t, {r('bf', 'body_ratio')}, {flag('bf > 0.6', 'body_ratio_above_60')} FROM b"),
    "rolling_atr_ratio": smoothed(f"round(CASE WHEN i >= 9 THEN avg(atrx) {over(5)} / avg(atrx) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END, 6) AS atr_ratio_rolling"),
    "atr_ratio": frame(RECURSIVE, recursive=True, select="SELECT instrument, round(avg(atrx) FILTER (i >= 120 AND i < 130) / avg(atrx) FILTER (i >= 100 AND i < 120), 6) AS atr_ratio FROM s GROUP BY instrument"),
    "volume_ratio": frame(f"v AS (SELECT *, {VOLUME} AS vr, {guarded('avg', 'volume', 20)} AS av FROM b)", select=f"SELECT instrument, t, {r('vr', 'vol_ratio')}, {flag('vr > 1.5', 'vol_above_1_5x')}, {flag('vr < 0.8', 'vol_below_0_8x')}, {r(f'regr_slope(volume, i) {over(5)} / av', 'vol_slope_5')} FROM v"),
    "key_volume_flags": frame(f"v AS (SELECT *, {guarded('avg', 'volume', 20)} AS av FROM b)", select=f"SELECT instrument, t, {flag('volume > av', 'vol_above_avg')}, {flag('volume < av', 'vol_below_avg')} FROM v"),
    "candle_delta_proxy": frame(f"v AS (SELECT *, {VOLUME} AS vr FROM b)", select="SELECT instrument, t, round(CASE WHEN high > low THEN (close - low) / (high - low) * vr ELSE 0 END, 6) AS candle_delta_proxy FROM v"),
    "vsa": frame(f"v AS (SELECT *, {guarded('avg', 'volume', 20)} AS av, avg(high - low) {over(20)} AS ar FROM b)", select=f"SELECT instrument, t, {flag('volume > av AND high - low < ar * 0.7', 'vsa_absorption')}, {flag('volume > av AND high - low > ar * 1.3', 'vsa_directional')} FROM v"),
    "wick_ratio": frame(select=f"SELECT instrument, t, {r('uw', 'upper_wick_ratio')}, {r('lw', 'lower_wick_ratio')} FROM b"),
    "displacement_candle": frame(RECURSIVE, """d AS (SELECT *, CAST(sign(close - open) AS BIGINT) AS dir, CASE WHEN atrx > 0 THEN abs(close - open) / atrx ELSE 0 END AS ba,
      coalesce(CASE WHEN close > open THEN (high - close) / (high - low) WHEN close < open THEN (close - low) / (high - low) END <= 0.2, FALSE) AS near, CASE WHEN close > open THEN lw WHEN close < open THEN uw ELSE 0 END AS opp FROM s),
      e AS (SELECT *, dir <> 0 AND ba >= 1.5 AND near AND bf >= 0.6 AND opp <= 0.2 AS on_ FROM d)""", recursive=True,
      select=f"SELECT instrument, t, dir AS displacement_direction, {r('ba', 'displacement_body_atr')}, {flag('near', 'displacement_close_extreme')}, {flag('on_', 'displacement_candle')}, {flag('on_ AND dir = 1', 'displacement_bull_candle')}, {flag('on_ AND dir = -1', 'displacement_bear_candle')} FROM e"),
    "asian_session": frame(f"""a AS (SELECT instrument, {DAY} AS day, max(high) AS ah, min(low) AS al FROM b WHERE {HOUR} < 8 GROUP BY ALL), m AS (SELECT *, avg(ah - al) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS av FROM a)""",
                           select=f"SELECT b.instrument, t, {r('ah', 'asian_high')}, {r('al', 'asian_low')}, {r('ah - al', 'asian_range')}, {r('(ah - al) / nullif(av, 0)', 'asian_range_ratio')} FROM b LEFT JOIN m ON m.instrument = b.instrument AND m.day = {DAY}"),
    "session": frame(f"h AS (SELECT *, {HOUR} AS hr FROM b)", select=f"""SELECT instrument, t, CAST(CASE WHEN hr < 8 THEN 0 WHEN hr < 13 THEN 1 WHEN hr < 17 THEN 3 WHEN hr < 22 THEN 2 ELSE 4 END AS BIGINT) AS session, {flag('hr BETWEEN 8 AND 9', 'london_open')}, {flag('hr BETWEEN 13 AND 14', 'ny_open')},
      {flag('hr >= 22', 'is_dead_zone')}, CAST(hr - CASE WHEN hr < 8 THEN 0 WHEN hr < 13 THEN 8 WHEN hr < 17 THEN 13 WHEN hr < 22 THEN 17 ELSE 22 END AS DOUBLE) AS hours_since_session FROM h"""),
    "time_features": frame(select=f"SELECT instrument, t, CAST(({DAY} + 3) % 7 AS BIGINT) AS day_of_week, {flag(f'({DAY} + 3) % 7 = 4', 'is_friday')}, CAST({HOUR} AS BIGINT) AS hour_of_day FROM b"),
    "round_numbers": frame(RECURSIVE, recursive=True, select=f"SELECT instrument, t, {flag('least(least(close % 50, 25), 50 - least(close % 50, 25)) < 0.3 * atrx', 'near_round_number')} FROM s"),
    "anchored_vwap": frame("""c AS (SELECT *, (high + low + close) / 3 AS tp FROM b), v AS (SELECT *, sum(tp * volume) FILTER (i >= 50) OVER w / sum(volume) FILTER (i >= 50) OVER w AS vw, sum(tp * tp * volume) FILTER (i >= 50) OVER w / sum(volume) FILTER (i >= 50) OVER w AS v2 FROM c
      WINDOW w AS (PARTITION BY instrument ORDER BY i)), d AS (SELECT *, sqrt(greatest(v2 - vw * vw, 0)) AS sd FROM v)""", select=f"""SELECT instrument, t, {r2('vw', 'avwap')}, {r2('vw + sd', 'avwap_upper_1')}, {r2('vw - sd', 'avwap_lower_1')}, {r2('vw + 2 * sd', 'avwap_upper_2')}, {r2('vw - 2 * sd', 'avwap_lower_2')},
      {r2('CASE WHEN vw IS NULL THEN NULL WHEN sd > 0 THEN (close - vw) / sd ELSE 0 END', 'avwap_dev_sigma')} FROM d"""),
    "pivots": frame("""p AS (SELECT *, max(high) OVER a AS hb, max(high) OVER f AS hf, min(low) OVER a AS lb, min(low) OVER f AS lf, count(*) OVER a AS na, count(*) OVER f AS nf FROM b WINDOW a AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))""",
                    select=f"SELECT instrument, t, {flag('na = 2 AND nf = 2 AND high > hb AND high >= hf', 'pivot_high')}, {flag('na = 2 AND nf = 2 AND low < lb AND low <= lf', 'pivot_low')} FROM p"),
    "q_time_slice": frame(select="SELECT instrument, t, close, volume FROM candles WHERE t BETWEEN 1704844800 AND 1705017600"),
    "q_latest_rows": frame(f"l AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n FROM b)", select=f"SELECT instrument, t, n, close, volume, {r('bf', 'body_ratio')} FROM l WHERE n <= 3"),  # noqa: F541
    "q_series_coverage": frame(select="SELECT instrument, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM candles GROUP BY instrument"),
    "volume_profile_last": frame("""z AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n FROM b), y AS (SELECT *, (high + low + close) / 3 AS tp, min(low) OVER (PARTITION BY instrument) AS lo, max(high) OVER (PARTITION BY instrument) AS hi FROM z WHERE n <= 80),
      bins AS (SELECT instrument, lo, hi, least(49, CAST(floor((tp - lo) / (hi - lo) * 50) AS BIGINT)) AS k, sum(volume)::DOUBLE AS v FROM y GROUP BY ALL), p AS (SELECT instrument, lo, hi, list_transform(range(50), lambda j: coalesce(map_from_entries(list((k, v)))[j], 0.0)) AS vs FROM bins GROUP BY ALL),
      g AS (SELECT instrument, lo, hi, vs, list_position(vs, list_max(vs)) - 1 AS a, list_position(vs, list_max(vs)) - 1 AS e, list_max(vs) AS inside, list_sum(vs) AS total, 0 AS k FROM p
        UNION ALL SELECT instrument, lo, hi, vs, a - down, e + (1 - down), inside + CASE WHEN down = 1 THEN vs[a] ELSE vs[e + 2] END, total, k + 1 FROM (SELECT *, CASE WHEN (CASE WHEN a > 0 THEN vs[a] ELSE 0 END >= CASE WHEN e < 49 THEN vs[e + 2] ELSE 0 END AND a > 0) OR e >= 49 THEN 1 ELSE 0 END AS down FROM g WHERE inside < total * 0.7 AND (a > 0 OR e < 49)))""", recursive=True,
      select="SELECT instrument, round(min(lo + (hi - lo) / 50 * (list_position(vs, list_max(vs)) - 0.5)), 6) AS poc, round(arg_max(lo + (hi - lo) / 50 * (e + 1), k), 6) AS vah, round(arg_max(lo + (hi - lo) / 50 * a, k), 6) AS val, round(min(total), 6) AS volume, 51::BIGINT AS n_edges FROM g GROUP BY instrument"),
}

for _name, _period in (("day", DAY), ("week", f"floor(({DAY} + 3) / 7)")):
    SQL[f"prev_{_name}"] = frame(
        f"g AS (SELECT instrument, {_period} AS p, max(high) AS h, min(low) AS l FROM b GROUP BY ALL), q AS (SELECT instrument, p, lag(h) OVER (PARTITION BY instrument ORDER BY p) AS h, lag(l) OVER (PARTITION BY instrument ORDER BY p) AS l FROM g)",
        select=f"SELECT b.instrument, t, h AS prev_{_name}_high, l AS prev_{_name}_low, {flag('close > h', f'above_prev_{_name}_high')}, {flag('close < l', f'below_prev_{_name}_low')} FROM b LEFT JOIN q ON q.instrument = b.instrument AND q.p = {_period}",
    )

P1 = "OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RUN = "OVER (PARTITION BY instrument ORDER BY i ROWS UNBOUNDED PRECEDING)"

# Higher highs and lows as one recursion over the swings, where the operators count within islands.
TREND = """
, tq AS (
  SELECT *, last_value(CASE WHEN sh = 1 THEN high END IGNORE NULLS) {P1} AS psh, last_value(CASE WHEN sl = 1 THEN low END IGNORE NULLS) {P1} AS psl FROM sl
), tx AS (
  SELECT *, CASE WHEN sh = 1 AND high > psh THEN 1 WHEN sh = 1 AND high < psh THEN -1 ELSE 0 END AS dh, CASE WHEN sl = 1 AND low > psl THEN 1 WHEN sl = 1 AND low < psl THEN -1 ELSE 0 END AS dl FROM tq
), tr AS (
  SELECT instrument, i, 0 AS hh, 0 AS lc, 0 AS st FROM tx WHERE i = 0
  UNION ALL
  SELECT instrument, i, hh, lc, CASE WHEN hh >= 2 THEN 1 WHEN lc >= 2 THEN -1 ELSE st END FROM (
    SELECT tx.instrument, tx.i, tr.st,
      CASE WHEN dl = 1 THEN greatest(CASE dh WHEN 1 THEN tr.hh + 1 WHEN -1 THEN 0 ELSE tr.hh END, 1) ELSE CASE dh WHEN 1 THEN tr.hh + 1 WHEN -1 THEN 0 ELSE tr.hh END END AS hh,
      CASE WHEN dl = -1 THEN greatest(CASE dh WHEN -1 THEN tr.lc + 1 WHEN 1 THEN 0 ELSE tr.lc END, 1) ELSE CASE dh WHEN -1 THEN tr.lc + 1 WHEN 1 THEN 0 ELSE tr.lc END END AS lc
    FROM tr JOIN tx ON tx.instrument = tr.instrument AND tx.i = tr.i + 1
  )
), tt AS (SELECT tx.*, hh, lc, st FROM tx JOIN tr USING (instrument, i))
""".replace("{P1}", P1)

BREAKS = """
, bc AS (
  SELECT *, CASE WHEN i >= 1 AND close > lh THEN lh END AS cb, CASE WHEN i >= 1 AND close < ll THEN ll END AS cs FROM {of}
), bs AS (
  SELECT *, CASE WHEN cb IS NOT NULL AND cb IS DISTINCT FROM last_value(cb IGNORE NULLS) {P1} THEN 1 ELSE 0 END AS bb, CASE WHEN cs IS NOT NULL AND cs IS DISTINCT FROM last_value(cs IGNORE NULLS) {P1} THEN 1 ELSE 0 END AS bx FROM bc
)
""".replace("{P1}", P1)

PIVOTS = """
pv AS (
  SELECT *, CASE WHEN na = 2 AND nf = 2 AND high > hb AND high >= hf THEN 1 ELSE 0 END AS ph1, CASE WHEN na = 2 AND nf = 2 AND low < lb AND low <= lf THEN 1 ELSE 0 END AS pl1 FROM (
    SELECT *, max(high) OVER a AS hb, max(high) OVER f AS hf, min(low) OVER a AS lb, min(low) OVER f AS lf, count(*) OVER a AS na, count(*) OVER f AS nf FROM s
    WINDOW a AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
), pw AS (
  SELECT *, last_value(CASE WHEN ph1 = 1 THEN high END IGNORE NULLS) OVER d AS lph, last_value(CASE WHEN pl1 = 1 THEN low END IGNORE NULLS) OVER d AS lpl, max(CASE WHEN ph1 = 1 THEN i END) OVER d AS iph, max(CASE WHEN pl1 = 1 THEN i END) OVER d AS ipl
  FROM pv WINDOW d AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)
)
"""


def swing_columns() -> str:
    out = []
    for side, on, level, last, index in (("high", "sh", "high", "lh", "lhi"), ("low", "sl", "low", "ll", "lli")):
        prominence = "high - greatest(hb, ha)" if side == "high" else "least(lb, la) - low"
        out += [
            f"CAST({on} AS BIGINT) AS swing_{side}", f"CASE WHEN {on} = 1 THEN {level} END AS swing_{side}_price", f"CAST(coalesce(lag({on}, 3) {LAG}, 0) AS BIGINT) AS swing_{side}_confirmed", f"CASE WHEN {on} = 1 THEN i + 3 ELSE -1 END AS swing_{side}_confirm_idx",
            f"CASE WHEN {on} = 1 THEN i ELSE -1 END AS swing_{side}_idx", r(f"CASE WHEN {on} = 1 THEN {prominence} END", f"swing_{side}_prominence"), r(f"CASE WHEN {on} = 1 THEN ({prominence}) / atrx END", f"swing_{side}_prominence_atr"),
            r(f"CASE WHEN {on} = 1 THEN ({prominence}) / atrx END", f"swing_{side}_strength"), f"{last} AS last_swing_{side}", f"CAST({index} AS DOUBLE) AS last_swing_{side}_idx", f"CAST(i - {index} AS DOUBLE) AS swing_{side}_age",
        ]
    return ", ".join(out)


def sweep_columns() -> str:
    out = []
    for side, wick in (("high", "uw"), ("low", "lw")):
        on = f"q{side[0]}"
        take = lambda x, n, on=on: f"round(CASE WHEN {on} THEN {x} END, 6) AS {n}"
        level, age, beyond, inside = f"v{side[0]}", f"a{side[0]}", f"x{side[0]}", f"y{side[0]}"
        out += [flag(on, f"sweep_{side}"), flag(on, f"sweep_confirmed_{side}"), take(f"{beyond} / atrx", f"sweep_{side}_magnitude"), take(f"{inside} / atrx", f"sweep_{side}_reclaim_atr"), take(wick, f"sweep_{side}_wick_frac"), take("bf", f"sweep_{side}_body_frac"),
                take(level, f"sweep_level_{side}"), take(f"CAST({age} AS DOUBLE)", f"sweep_level_{side}_age")]
    out += ["round(greatest(CASE WHEN qh THEN xh / atrx END, CASE WHEN ql THEN xl / atrx END), 6) AS sweep_magnitude", "CAST(coalesce(qh, FALSE) AS BIGINT) - CAST(coalesce(ql, FALSE) AS BIGINT) AS sweep_side"]
    return ", ".join(out)


def sweeps(of: str, vh: str, ah: str, vl: str, al: str, more: tuple[str, str] = ("TRUE", "TRUE")) -> str:
    return f""", sx AS (SELECT *, {vh} AS vh, i - {ah} AS ah, {vl} AS vl, i - {al} AS al, high - {vh} AS xh, {vh} - close AS yh, {vl} - low AS xl, close - {vl} AS yl, lead(close) {LAG} AS nc FROM {of}),
      sy AS (SELECT *, i >= 1 AND xh > 0 AND yh > 0 AND xh / atrx >= 0.2 AND uw >= 0.25 AND bf <= 0.8 AND ah <= 80 AND {more[0]} AS qh, i >= 1 AND xl > 0 AND yl > 0 AND xl / atrx >= 0.2 AND lw >= 0.25 AND bf <= 0.8 AND al <= 80 AND {more[1]} AS ql FROM sx)"""


GAPS = """
, ga AS (SELECT *, lag(high) {L} AS h0, lag(low) {L} AS l0, lead(low) {L} AS l2, lead(high) {L} AS h2, lead(close) {L} AS c2, lead(lph) {L} AS p2, lead(lpl) {L} AS q2, abs(close - open) / atrx AS ba FROM pw),
gb AS (SELECT *, coalesce(l2 - h0 > 0 AND l2 - h0 >= 0.3 * atrx AND ba >= 0.8 AND h0 IS NOT NULL, FALSE) AS u, coalesce(l0 - h2 > 0 AND l0 - h2 >= 0.3 * atrx AND ba >= 0.8 AND l0 IS NOT NULL, FALSE) AS d FROM ga)
""".replace("{L}", LAG)

BLOCKS = """
, oa AS (
  SELECT *, sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER w / 4.0 AS fu, sum(CASE WHEN close < open THEN 1 ELSE 0 END) OVER w / 4.0 AS fd, close - min(low) OVER w AS mu, max(high) OVER w - close AS md, sum(greatest(close - open, 0)) OVER w AS bu, sum(greatest(open - close, 0)) OVER w AS bd,
    first_value(close) OVER w AS c0 FROM pw WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
), ob AS (
  SELECT *, i >= 3 AND fu >= 0.67 AND mu >= 1.5 * atrx AND bu >= 0.8 * atrx AND close > c0 AND high > lph AND close > lph AS iu, i >= 3 AND fd >= 0.67 AND md >= 1.5 * atrx AND bd >= 0.8 * atrx AND close < c0 AND low < lpl AND close < lpl AS id FROM oa
), oc AS (
  SELECT a.instrument, a.i, 'u' AS side, max(k.i) AS k FROM ob a JOIN ob k ON k.instrument = a.instrument AND k.i BETWEEN a.i - 13 AND a.i - 4 AND k.close < k.open AND (k.open - k.low) / a.atrx <= 3 WHERE a.iu GROUP BY ALL
  UNION ALL
  SELECT a.instrument, a.i, 'd' AS side, max(k.i) AS k FROM ob a JOIN ob k ON k.instrument = a.instrument AND k.i BETWEEN a.i - 13 AND a.i - 4 AND k.close > k.open AND (k.high - k.open) / a.atrx <= 3 WHERE a.id GROUP BY ALL
), od AS (SELECT instrument, k, max(CASE WHEN side = 'u' THEN 1 END) AS u, max(CASE WHEN side = 'd' THEN 1 END) AS d, min(i) AS i0 FROM oc GROUP BY ALL),
oe AS (SELECT ob.*, od.u, od.d, f.atrx AS fa FROM ob LEFT JOIN od ON od.instrument = ob.instrument AND od.k = ob.i LEFT JOIN ob f ON f.instrument = od.instrument AND f.i = od.i0)
"""

AMD_TEMPLATE = """
, am AS (
  SELECT *, CASE WHEN i >= 19 THEN max(high) OVER w END AS bh, CASE WHEN i >= 19 THEN min(low) OVER w END AS bl, greatest(least(high, lag(high) OVER o) - greatest(low, lag(low) OVER o), 0) / nullif(greatest(high, lag(high) OVER o) - least(low, lag(low) OVER o), 0) AS ov, abs(close - lag(close) OVER o) AS mv,
    abs(close - lag(close, 19) OVER o) AS net, CASE WHEN count(atrx) OVER f = 50 THEN len(list_filter(list(round(atrx, 10)) OVER f, lambda v: v <= round(atrx, 10))) / 50.0::DOUBLE * 100 END AS pct
  FROM d2 WINDOW o AS (PARTITION BY instrument ORDER BY i), w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
), an AS (
  SELECT *, bh - bl AS bw, (bh + bl) / 2 AS bm, CASE WHEN i >= 1 AND count(CASE WHEN i >= 1 THEN ov END) OVER t = 10 THEN avg(CASE WHEN i >= 1 THEN ov END) OVER t END AS os, net / nullif(CASE WHEN count(mv) OVER w = 20 THEN sum(mv) OVER w END, 0) AS ef, coalesce(abs(bh - high) <= (bh - bl) * 0.10, FALSE)::INT AS th, coalesce(abs(low - bl) <= (bh - bl) * 0.10, FALSE)::INT AS tl
  FROM am WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), t AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
), ao AS (
  SELECT *, coalesce(pct <= {pct}, FALSE)::INT + coalesce(bw / nullif(atrx, 0) <= {watr} AND bw / nullif(abs(close), 0) <= {wpct}, FALSE)::INT + coalesce(os >= {ov}, FALSE)::INT + coalesce(ef <= {ef}, FALSE)::INT + coalesce(i >= 19 AND sum(th) OVER w >= 1 AND sum(tl) OVER w >= 1, FALSE)::INT AS sc
  FROM an WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), ap AS (SELECT *, CASE WHEN sc = 5 AND min(sc) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) = 5 AND i >= {back} THEN 1 ELSE 0 END AS acc FROM ao),
aq AS (SELECT *, lag(bh) {L} AS qh, lag(bl) {L} AS ql, lag(bm) {L} AS qm, coalesce(lag(acc) {L}, 0) = 1 AS pa FROM ap),
ar AS (
  SELECT *, coalesce(pa AND ((low < ql AND low >= ql - 0.15 * atrx AND close >= ql + 0.1 * (qh - ql)) OR (high > qh AND on_ AND dir = 1)), FALSE) AS mb, coalesce(pa AND ((high > qh AND high <= qh + 0.15 * atrx AND close <= qh - 0.1 * (qh - ql)) OR (low < ql AND on_ AND dir = -1)), FALSE) AS ms,
    coalesce(close BETWEEN ql AND qh, FALSE) AS re, coalesce(close BETWEEN ql - 0.2 * (qh - ql) AND qh + 0.2 * (qh - ql), FALSE) AS rb, coalesce(abs(close - qm) / nullif(atrx, 0) >= 0.35 AND abs(close - qm) / nullif(qh - ql, 0) >= 0.3, FALSE) AS far FROM aq
), az AS (SELECT *, coalesce(close > qh AND far, FALSE) AS du, coalesce(close < ql AND far, FALSE) AS dd FROM ar)
""".replace("{L}", LAG)



def amd(pct: float = 45, watr: float = 12, wpct: float = 0.04, ov: float = 0.4, ef: float = 0.35, streak: int = 8) -> str:
    text = AMD_TEMPLATE
    for name, value in {"pct": pct, "watr": watr, "wpct": wpct, "ov": ov, "ef": ef, "back": streak - 1}.items():
        text = text.replace(f"{{{name}}}", str(value))
    return text


DISPLACED = """
, d0 AS (SELECT *, CAST(sign(close - open) AS BIGINT) AS dir FROM s),
d2 AS (SELECT *, dir <> 0 AND abs(close - open) / atrx >= 1.5 AND coalesce(CASE WHEN close > open THEN (high - close) / (high - low) WHEN close < open THEN (close - low) / (high - low) END <= 0.2, FALSE) AND bf >= 0.6 AND CASE WHEN close > open THEN lw WHEN close < open THEN uw ELSE 0 END <= 0.2 AS on_ FROM d0)
"""


FEATURE_COLUMNS = f"""bh AS amd_box_high, bl AS amd_box_low, {r('bm', 'amd_box_mid')}, {r('bw', 'amd_box_width')}, CAST(sc AS BIGINT) AS amd_compression_score, {r('os', 'amd_overlap_score')}, {r('ef', 'amd_efficiency')}, CAST(acc AS BIGINT) AS amd_accumulation_active,
      {flag('mb OR ms', 'amd_manipulation_candidate')}, CAST(CASE WHEN mb THEN 1 WHEN ms THEN -1 ELSE 0 END AS BIGINT) AS amd_manipulation_direction, {flag('re', 'amd_reentry_strict')}, {flag('rb', 'amd_reentry_buffered')}, {flag(f'du AND lag(du) {LAG} AND NOT re', 'amd_distribution_bull_candidate')}, {flag(f'dd AND lag(dd) {LAG} AND NOT re', 'amd_distribution_bear_candidate')}"""


def labelled(label: str) -> str:
    return f"SELECT instrument, {label}, count(*) AS n FROM tt GROUP BY ALL"


SQL |= {
    "swings": swinging(swing_columns()),
    "swings_causal": frame(RECURSIVE, f"""c0 AS (SELECT *, high >= max(high) OVER p AS h0, low <= min(low) OVER p AS l0 FROM s WINDOW p AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
      c1 AS (SELECT instrument, i, FALSE AS h1, FALSE AS l1 FROM c0 WHERE i = 0 UNION ALL SELECT c0.instrument, c0.i, coalesce(h0, FALSE) AND NOT c1.h1, coalesce(l0, FALSE) AND NOT c1.l1 FROM c1 JOIN c0 ON c0.instrument = c1.instrument AND c0.i = c1.i + 1), c2 AS (SELECT * FROM c0 JOIN c1 USING (instrument, i))""", recursive=True,
      select=f"""SELECT instrument, t, {flag('h1', 'swing_high')}, {flag('l1', 'swing_low')}, CASE WHEN h1 THEN high END AS swing_high_price, CASE WHEN l1 THEN low END AS swing_low_price, last_value(CASE WHEN h1 THEN high END IGNORE NULLS) {RUN} AS last_swing_high, last_value(CASE WHEN l1 THEN low END IGNORE NULLS) {RUN} AS last_swing_low,
      CAST(i - max(CASE WHEN h1 THEN i END) {RUN} AS DOUBLE) AS swing_high_age, CAST(i - max(CASE WHEN l1 THEN i END) {RUN} AS DOUBLE) AS swing_low_age FROM c2"""),
    "last_pivots": frame(RECURSIVE, PIVOTS, recursive=True, select="SELECT instrument, t, lph AS last_pivot_high, lpl AS last_pivot_low, iph AS last_pivot_high_idx, ipl AS last_pivot_low_idx FROM pw"),
    "trend_state": swinging("CAST(hh AS BIGINT) AS hh_count, CAST(lc AS BIGINT) AS ll_count, CAST(st AS BIGINT) AS trend_state", TREND, "tt"),
    "bos": swinging(f"""CAST(bb AS BIGINT) AS bos_bull, CAST(bx AS BIGINT) AS bos_bear, CAST(coalesce(last_value(CASE WHEN bb = 1 THEN 1 WHEN bx = 1 THEN -1 END IGNORE NULLS) {RUN}, 0) AS BIGINT) AS bos_direction, round(CASE WHEN bb = 1 OR bx = 1 THEN abs(close - open) / atrx END, 6) AS bos_candle_body_atr,
      CAST(CASE WHEN bb = 1 THEN i - lhi WHEN bx = 1 THEN i - lli END AS DOUBLE) AS bos_swing_age""", BREAKS.format(of="sl"), "bs"),
    "choch": swinging(f"{flag('bb = 1 AND pst = -1', 'choch_bull')}, {flag('bx = 1 AND pst = 1', 'choch_bear')}, round(CASE WHEN (bb = 1 AND pst = -1) OR (bx = 1 AND pst = 1) THEN abs(close - open) / atrx END, 6) AS choch_candle_body_atr", TREND + BREAKS.format(of="tt") + f", ch AS (SELECT *, lag(st) {LAG} AS pst FROM bs)", "ch"),
    "rsi_divergence": swinging(f"{r('rsi', 'rsi_14')}, {flag('sh = 1 AND high > psh AND rsi < prh', 'rsi_div_bearish')}, {flag('sl = 1 AND low < psl AND rsi > prl', 'rsi_div_bullish')}", f""", rd AS (SELECT *, last_value(CASE WHEN sh = 1 THEN high END IGNORE NULLS) {P1} AS psh, last_value(CASE WHEN sl = 1 THEN low END IGNORE NULLS) {P1} AS psl,
      (last_value(CASE WHEN sh = 1 THEN {{'r': rsi}} END IGNORE NULLS) {P1}).r AS prh, (last_value(CASE WHEN sl = 1 THEN {{'r': rsi}} END IGNORE NULLS) {P1}).r AS prl FROM sl)""", "rd"),
    "liquidity_sweep": swinging(sweep_columns(), sweeps("sl", "lh", "lhi", "ll", "lli"), "sy"),
    "liquidity_sweep_confirmed": frame(RECURSIVE, PIVOTS + sweeps("pw", "lph", "iph", "lpl", "ipl", ("nc < (open + close) / 2", "nc > (open + close) / 2")), recursive=True, select=f"SELECT instrument, t, {sweep_columns()} FROM sy"),
    "fvg_candidates": frame(RECURSIVE, PIVOTS + GAPS, recursive=True, select=f"""SELECT instrument, t, {flag('u', 'fvg_bull')}, {flag('d', 'fvg_bear')}, CASE WHEN u THEN h0 END AS fvg_bull_low, CASE WHEN u THEN l2 END AS fvg_bull_high, CASE WHEN d THEN l0 END AS fvg_bear_high, CASE WHEN d THEN h2 END AS fvg_bear_low,
      round(CASE WHEN u THEN (l2 - h0) / atrx WHEN d THEN (l0 - h2) / atrx END, 6) AS fvg_size_atr, CASE WHEN u THEN i + 1 ELSE -1 END AS fvg_bull_confirm_idx, CASE WHEN d THEN i + 1 ELSE -1 END AS fvg_bear_confirm_idx, CASE WHEN u OR d THEN 1.0::DOUBLE END AS fvg_confirm_delay, round(CASE WHEN u OR d THEN ba END, 6) AS fvg_mid_body_atr,
      {flag('u AND c2 > p2', 'fvg_bos_bull')}, {flag('d AND c2 < q2', 'fvg_bos_bear')} FROM gb"""),
    "order_blocks": frame(RECURSIVE, PIVOTS + BLOCKS, recursive=True, select=f"""SELECT instrument, t, {flag('u = 1', 'ob_bull')}, {flag('d = 1', 'ob_bear')}, CASE WHEN u = 1 THEN open END AS ob_bull_high, CASE WHEN u = 1 THEN low END AS ob_bull_low, CASE WHEN d = 1 THEN high END AS ob_bear_high, CASE WHEN d = 1 THEN open END AS ob_bear_low,
      round(CASE WHEN u = 1 THEN (open - low) / fa WHEN d = 1 THEN (high - open) / fa END, 6) AS ob_width_atr FROM oe"""),
    "amd_features": frame(RECURSIVE + DISPLACED + amd(), recursive=True, select=f"SELECT instrument, t, {FEATURE_COLUMNS} FROM az"),
    "q_trend_distribution": frame(RECURSIVE, SWINGS + TREND, recursive=True, select=labelled("CASE st WHEN 1 THEN 'BULL' WHEN -1 THEN 'BEAR' ELSE 'UNDEFINED' END AS trend")),
    "q_last_events": frame(RECURSIVE, SWINGS, recursive=True, select="SELECT * FROM (SELECT instrument, t, row_number() OVER (PARTITION BY instrument ORDER BY t DESC) AS n, high AS swing_high_price FROM sl WHERE sh = 1) WHERE n <= 5"),
    "avwap_from_last_swing": frame(RECURSIVE, SWINGS + """, aa AS (SELECT *, (high + low + close) / 3 AS tp, coalesce(max(CASE WHEN sh = 1 OR sl = 1 THEN i END) OVER (PARTITION BY instrument), 0) AS a0 FROM sl), av AS (SELECT *, sum(CASE WHEN i >= a0 THEN tp * volume END) OVER w / sum(CASE WHEN i >= a0 THEN volume END) OVER w AS vw, sum(CASE WHEN i >= a0 THEN tp * tp * volume END) OVER w / sum(CASE WHEN i >= a0 THEN volume END) OVER w AS v2 FROM aa
      WINDOW w AS (PARTITION BY instrument ORDER BY i)), ad AS (SELECT *, sqrt(greatest(v2 - vw * vw, 0)) AS sd FROM av)""", recursive=True, select=f"""SELECT instrument, t, {r2('vw', 'avwap')}, {r2('vw + sd', 'avwap_upper_1')}, {r2('vw - sd', 'avwap_lower_1')}, {r2('vw + 2 * sd', 'avwap_upper_2')}, {r2('vw - 2 * sd', 'avwap_lower_2')}, {r2('CASE WHEN vw IS NULL THEN NULL WHEN sd > 0 THEN (close - vw) / sd ELSE 0 END', 'avwap_dev_sigma')} FROM ad"""),
}

REGIME = f"""
, ra AS (SELECT *, CASE WHEN i >= 19 THEN 4 * stddev_samp(close) {over(20)} / avg(close) {over(20)} END AS bw, (e20 - lag(e20, 3) {LAG}) / atr AS slope FROM tt), rb AS (SELECT *, {rank('bw', 50)} AS pct FROM ra),
rc AS (SELECT *, CASE WHEN adx < 20 AND coalesce(pct < 40, FALSE) THEN 0 WHEN adx > 25 AND (hh >= 2 OR lc >= 2) AND abs(slope) > 0.1 THEN 2 ELSE 1 END AS rg FROM rb)
"""
LABEL = "CASE rg WHEN 0 THEN 'RANGING' WHEN 2 THEN 'TRENDING' ELSE 'TRANSITIONAL' END"
RANGES = {"atr_14": "atr", "rsi_14": "rsi", "adx_14": "adx", "macd_hist": "hist", "bb_width": "bw", "vol_ratio": "vr"}
RATES = {
    "body_ratio_above_60": "bf > 0.6", "vol_above_1_5x": "volume / av > 1.5", "vol_below_0_8x": "volume / av < 0.8", "vol_above_avg": "volume > av", "vol_below_avg": "volume < av", "vsa_absorption": "volume > av AND high - low < ar * 0.7",
    "vsa_directional": "volume > av AND high - low > ar * 1.3", "london_open": "hr BETWEEN 8 AND 9", "ny_open": "hr BETWEEN 13 AND 14", "is_dead_zone": "hr >= 22", "is_friday": "dow = 4", "swing_high": "sh = 1", "swing_low": "sl = 1",
    "above_prev_day_high": "close > pdh", "below_prev_day_low": "close < pdl",
}
UNPIVOT_RANGES = " UNION ALL ".join(f"SELECT instrument, '{n}' AS indicator, {c} AS v FROM rx" for n, c in RANGES.items())
UNPIVOT_RATES = " UNION ALL ".join(f"SELECT instrument, '{n}' AS flag, CASE WHEN coalesce({c}, FALSE) THEN 1 ELSE 0 END AS v FROM fx" for n, c in RATES.items())
DAYS = f"dg AS (SELECT instrument, {DAY} AS p, max(high) AS h, min(low) AS l FROM b GROUP BY ALL), dq AS (SELECT instrument, p, lag(h) OVER (PARTITION BY instrument ORDER BY p) AS pdh, lag(l) OVER (PARTITION BY instrument ORDER BY p) AS pdl FROM dg)"
WEEKS = DAYS.replace("dg", "wg").replace("dq", "wq").replace("pdh", "pwh").replace("pdl", "pwl").replace(DAY, f"floor(({DAY} + 3) / 7)")
XAU = "CASE WHEN close >= open THEN 1 ELSE -1 END"

SQL |= {
    "regime": swinging(f"CAST(rg AS BIGINT) AS regime, {LABEL} AS regime_label", TREND + REGIME, "rc"),
    "q_regime_distribution": frame(RECURSIVE, SWINGS + TREND + REGIME, recursive=True, select=f"SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY instrument), 6) AS percent FROM (SELECT instrument, {LABEL} AS regime_label, count(*) AS n FROM rc GROUP BY ALL)"),
    "q_indicator_ranges": frame(RECURSIVE, f"rx AS (SELECT *, CASE WHEN i >= 19 THEN 4 * stddev_samp(close) {over(20)} / avg(close) {over(20)} END AS bw, {VOLUME} AS vr FROM s)", recursive=True, select=f"SELECT instrument, indicator, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM ({UNPIVOT_RANGES}) GROUP BY ALL"),
    "q_warm_up_gaps": frame(RECURSIVE, f"wx AS (SELECT *, CASE WHEN i >= 19 THEN 4 * stddev_samp(close) {over(20)} / avg(close) {over(20)} END AS bw FROM s), wy AS (SELECT *, {rank('bw', 50)} AS pct FROM wx)", recursive=True, select="SELECT instrument, count(*) FILTER (e20 IS NULL OR atr IS NULL OR rsi IS NULL OR adx IS NULL OR hist IS NULL OR bw IS NULL OR pct IS NULL) AS n_missing FROM wy WHERE i < 200 GROUP BY instrument"),
    "q_flag_rates": frame(RECURSIVE, SWINGS, DAYS, f"fa AS (SELECT *, {guarded('avg', 'volume', 20)} AS av, avg(high - low) {over(20)} AS ar, {HOUR} AS hr, ({DAY} + 3) % 7 AS dow, {DAY} AS p FROM sl), fx AS (SELECT fa.*, pdh, pdl FROM fa LEFT JOIN dq ON dq.instrument = fa.instrument AND dq.p = fa.p)", recursive=True,
                          select=f"SELECT instrument, flag, CAST(sum(v) AS BIGINT) AS n, round(avg(v) * 100, 6) AS percent FROM ({UNPIVOT_RATES}) GROUP BY ALL"),
    "q_latest_snapshot": frame(DAYS, WEEKS, select=f"""SELECT b.instrument, t, close, pdh AS prev_day_high, pdl AS prev_day_low, pwh AS prev_week_high, pwl AS prev_week_low FROM b LEFT JOIN dq ON dq.instrument = b.instrument AND dq.p = {DAY} LEFT JOIN wq ON wq.instrument = b.instrument AND wq.p = floor(({DAY} + 3) / 7)
      QUALIFY row_number() OVER (PARTITION BY b.instrument ORDER BY t DESC) = 1"""),
    "costs": frame(select=f"SELECT instrument, t, CAST({XAU} AS BIGINT) AS side, 0.5::DOUBLE AS cost, round(close + {XAU} - {XAU} * 0.5, 6) AS target_net, round(close - {XAU} + {XAU} * 0.5, 6) AS stop_net FROM b"),
    "event_proximity": frame(select="SELECT instrument, t, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.value > 450 AND abs(CAST(floor(epoch(e.ts)) AS BIGINT) - b.t) <= 7200) THEN 1 ELSE 0 END::BIGINT AS near_event FROM b"),
    "stream_bars": frame(price="value", select="SELECT instrument, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM candles WHERE t + 3600 <= (SELECT epoch(max(ts)) - 3600 FROM events)"),
}


# The phase automaton: an action for each bar from the state before it, and the state that it leads to.
PHASES = """
, st AS (
  SELECT instrument, i, -1 AS ph, 0 AS dr, 0 AS seq, 0 AS age, 0 AS mn, 0 AS gr, 0 AS sa, 0 AS fo, NULL::DOUBLE AS xh, NULL::DOUBLE AS xl, NULL::DOUBLE AS fh, NULL::DOUBLE AS fl, NULL::DOUBLE AS fm FROM az WHERE i = 0
  UNION ALL
  SELECT instrument, i, CASE WHEN a IN ('A', 'F', 'g') THEN 0 WHEN a IN ('U', 'u') THEN -1 WHEN a IN ('M', 'm', 'k') THEN 1 ELSE 2 END, CASE WHEN a = 'M' THEN 1 WHEN a = 'm' THEN -1 WHEN a IN ('k', 'D', 'd') THEN dr ELSE 0 END, CASE WHEN a = 'A' THEN seq + 1 ELSE seq END,
    CASE WHEN a IN ('A', 'M', 'm', 'D') THEN 1 WHEN a IN ('U', 'u') THEN 0 ELSE age + 1 END, CASE WHEN a IN ('M', 'm') THEN 1 WHEN a IN ('k', 'D') THEN mn + 1 WHEN a IN ('F', 'g', 'd') THEN mn ELSE 0 END, CASE WHEN a = 'g' THEN gr + 1 ELSE 0 END,
    CASE WHEN a = 'd' THEN CASE WHEN fresh THEN 0 ELSE sa + 1 END ELSE 0 END, CASE WHEN a = 'k' AND away THEN fo + 1 ELSE 0 END, CASE WHEN a = 'D' OR (a = 'd' AND fresh AND dr = 1) THEN high WHEN a = 'd' THEN xh END, CASE WHEN a = 'D' OR (a = 'd' AND fresh AND dr = -1) THEN low WHEN a = 'd' THEN xl END,
    CASE WHEN a IN ('A', 'F') THEN bh WHEN a IN ('U', 'u') THEN NULL ELSE fh END, CASE WHEN a IN ('A', 'F') THEN bl WHEN a IN ('U', 'u') THEN NULL ELSE fl END, CASE WHEN a IN ('A', 'F') THEN bm WHEN a IN ('U', 'u') THEN NULL ELSE fm END
  FROM (
    SELECT *, CASE ph WHEN -1 THEN CASE WHEN acc = 1 THEN 'A' ELSE 'u' END WHEN 0 THEN CASE WHEN acc = 1 THEN 'F' WHEN mb THEN 'M' WHEN ms THEN 'm' WHEN gr + 1 > 2 THEN 'U' ELSE 'g' END
      WHEN 1 THEN CASE WHEN away AND fo + 1 >= 4 THEN 'D' WHEN mn + 1 > 8 THEN CASE WHEN acc = 1 THEN 'A' ELSE 'U' END ELSE 'k' END
      ELSE CASE WHEN close BETWEEN fl AND fh OR (NOT fresh AND sa + 1 > 4) THEN CASE WHEN acc = 1 THEN 'A' ELSE 'U' END WHEN acc = 1 THEN 'A' ELSE 'd' END END AS a
    FROM (
      SELECT az.instrument, az.i, high, low, close, acc, mb, ms, bh, bl, bm, ph, dr, seq, age, mn, gr, sa, fo, xh, xl, fh, fl, fm, coalesce(abs(close - fm) / atrx >= 0.75 AND abs(close - fm) / (fh - fl) >= 0.6 AND CASE WHEN dr = 1 THEN close > fh ELSE close < fl END, FALSE) AS away,
        coalesce(CASE WHEN dr = 1 THEN close > fh AND high >= xh + 0.1 * atrx WHEN dr = -1 THEN close < fl AND low <= xl - 0.1 * atrx END, FALSE) AS fresh
      FROM st JOIN az ON az.instrument = st.instrument AND az.i = st.i + 1
    )
  )
), sx AS (SELECT az.*, ph, dr, seq, age, fh, fl, fm FROM az JOIN st USING (instrument, i)),
lb AS (SELECT *, list(high) OVER f AS hs, list(low) OVER f AS ls, ph = 1 AND dr <> 0 AND atrx > 0 AND fh - fl > 0 AND count(*) OVER f > 0 AS lon FROM sx WINDOW f AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
lc AS (SELECT *, CASE WHEN dr = 1 THEN list_position(list_transform(hs, lambda v: v >= close + 1.5 * atrx), TRUE) ELSE list_position(list_transform(ls, lambda v: v <= close - 1.5 * atrx), TRUE) END AS tg,
  CASE WHEN dr = 1 THEN list_position(list_transform(ls, lambda v: v <= close - 0.5 * (fh - fl)), TRUE) ELSE list_position(list_transform(hs, lambda v: v >= close + 0.5 * (fh - fl)), TRUE) END AS sp FROM lb)
"""
LOOSE = amd(pct=80, watr=99, wpct=9, ov=0.1, ef=0.6, streak=3)
PHASE_COLUMNS = """CAST(ph AS BIGINT) AS amd_phase, CAST(dr AS BIGINT) AS amd_direction, CAST(seq AS BIGINT) AS amd_sequence_id, CAST(age AS BIGINT) AS amd_bars_in_phase, fh AS amd_active_box_high, fl AS amd_active_box_low, round(fm, 6) AS amd_active_box_mid,
  CAST(ph = 0 AS BIGINT) AS amd_is_accumulation, CAST(ph = 1 AS BIGINT) AS amd_is_manipulation, CAST(ph = 2 AS BIGINT) AS amd_is_distribution"""

LABEL_COLUMNS = """CAST(CASE WHEN lon AND tg > 0 AND (coalesce(sp, 0) = 0 OR tg < sp) THEN 1 WHEN lon AND sp > 0 AND (coalesce(tg, 0) = 0 OR sp < tg) THEN -1 ELSE 0 END AS BIGINT) AS amd_label_outcome, round(CASE WHEN lon THEN CASE WHEN dr = 1 THEN list_max(hs) - close ELSE close - list_min(ls) END / atrx END, 6) AS amd_label_forward_return_atr"""

# Swings known at once, with ties.
AT_ONCE = SWINGS.replace("AND (high > hb OR high > ha)", "").replace("AND (low < lb OR low < la)", "").replace("BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING", "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

PROFILES = """
, va AS (SELECT instrument, 80 + 20 * k AS anchor FROM (SELECT instrument, max(i) AS n FROM s GROUP BY instrument), LATERAL (SELECT unnest(range(0, greatest((n - 80) // 20 + 1, 0))) AS k) WHERE n >= 80),
vb AS (SELECT va.instrument, anchor, (high + low + close) / 3 AS tp, volume, min(low) OVER w AS lo, max(high) OVER w AS hi FROM va JOIN s ON s.instrument = va.instrument AND s.i >= anchor - 80 AND s.i < anchor WINDOW w AS (PARTITION BY va.instrument, anchor)),
vc AS (SELECT instrument, anchor, lo, hi, least(49, CAST(floor((tp - lo) / (hi - lo) * 50) AS BIGINT)) AS k, sum(volume)::DOUBLE AS v FROM vb WHERE hi > lo GROUP BY ALL),
vd AS (SELECT instrument, anchor, lo, hi, list_transform(range(50), lambda j: coalesce(map_from_entries(list((k, v)))[j], 0.0)) AS vs FROM vc GROUP BY ALL),
vg AS (SELECT instrument, anchor, lo, hi, vs, list_position(vs, list_max(vs)) - 1 AS a, list_position(vs, list_max(vs)) - 1 AS e, list_max(vs) AS inside, list_sum(vs) AS total, 0 AS k FROM vd
  UNION ALL SELECT instrument, anchor, lo, hi, vs, a - down, e + (1 - down), inside + CASE WHEN down = 1 THEN vs[a] ELSE vs[e + 2] END, total, k + 1 FROM (SELECT *, CASE WHEN (CASE WHEN a > 0 THEN vs[a] ELSE 0 END >= CASE WHEN e < 49 THEN vs[e + 2] ELSE 0 END AND a > 0) OR e >= 49 THEN 1 ELSE 0 END AS down FROM vg WHERE inside < total * 0.7 AND (a > 0 OR e < 49))),
vh AS (SELECT instrument, anchor, min(lo + (hi - lo) / 50 * (list_position(vs, list_max(vs)) - 0.5)) AS poc, arg_max(lo + (hi - lo) / 50 * (e + 1), k) AS vah, arg_max(lo + (hi - lo) / 50 * a, k) AS val FROM vg GROUP BY ALL),
vi AS (SELECT s.*, poc, vah, val FROM s LEFT JOIN vh ON vh.instrument = s.instrument AND vh.anchor = CASE WHEN s.i >= 80 THEN 80 + 20 * ((s.i - 80) // 20) END)
"""

SQL |= {
    "amd_state": frame(RECURSIVE + DISPLACED + LOOSE + PHASES, recursive=True, select=f"SELECT instrument, t, {PHASE_COLUMNS} FROM sx"),
    "amd_labels": frame(RECURSIVE + DISPLACED + LOOSE + PHASES, recursive=True, select=f"SELECT instrument, t, {LABEL_COLUMNS} FROM lc"),
    "swings_at_once": frame(RECURSIVE, AT_ONCE, recursive=True, select=f"SELECT instrument, t, {swing_columns()} FROM sl"),
    "volume_profile": frame(RECURSIVE + PROFILES, recursive=True, select=f"SELECT instrument, t, {r('poc', 'vp_poc')}, {r('vah', 'vp_vah')}, {r('val', 'vp_val')}, {r('CASE WHEN atrx > 0 THEN abs(close - poc) / atrx END', 'vp_poc_distance_atr')} FROM vi"),
}

# Gaps of a side that overlap within two bars of the first are one, told by a recursion over the gaps; inversions by joins of zones and bars.
ZONES = """
, cd AS (
  SELECT instrument, 'u' AS side, i, h0 AS lo, l2 AS hi, (l2 - h0) / atrx AS size, ba, coalesce(c2 > p2, FALSE)::INT AS bos, row_number() OVER (PARTITION BY instrument ORDER BY i) AS n FROM gb WHERE u
  UNION ALL SELECT instrument, 'd', i, h2, l0, (l0 - h2) / atrx, ba, coalesce(c2 < q2, FALSE)::INT, row_number() OVER (PARTITION BY instrument ORDER BY i) FROM gb WHERE d
), mg AS (
  SELECT instrument, side, n, i, i AS head, lo, hi, size, ba, bos FROM cd WHERE n = 1
  UNION ALL
  SELECT instrument, side, n, i, CASE WHEN one THEN head ELSE i END, CASE WHEN one THEN least(lo, mlo) ELSE lo END, CASE WHEN one THEN greatest(hi, mhi) ELSE hi END, CASE WHEN one THEN greatest(size, msize) ELSE size END, CASE WHEN one THEN greatest(ba, mba) ELSE ba END, CASE WHEN one THEN greatest(bos, mbos) ELSE bos END
  FROM (SELECT cd.*, mg.head, mg.lo AS mlo, mg.hi AS mhi, mg.size AS msize, mg.ba AS mba, mg.bos AS mbos, cd.i - mg.head <= 2 AND cd.lo <= mg.hi AND mg.lo <= cd.hi AS one FROM mg JOIN cd ON cd.instrument = mg.instrument AND cd.side = mg.side AND cd.n = mg.n + 1)
), zn AS (SELECT instrument, side, head, max(i) + 1 AS confirm, arg_max(lo, n) AS lo, arg_max(hi, n) AS hi, arg_max(size, n) AS size, arg_max(ba, n) AS ba, arg_max(bos, n) AS bos FROM mg GROUP BY ALL),
zl AS (SELECT *, coalesce(lead(head, 5) OVER (PARTITION BY instrument, side ORDER BY head), 1000000000) AS until FROM zn),
zb AS (SELECT *, (SELECT min(i) FROM s WHERE s.instrument = zl.instrument AND i > confirm AND i < until AND CASE WHEN side = 'u' THEN close < lo ELSE close > hi END) AS bk FROM zl),
zr AS (SELECT *, (SELECT min(i) FROM s WHERE s.instrument = zb.instrument AND i > bk AND i < until AND CASE WHEN side = 'u' THEN high >= lo ELSE low <= hi END) AS rt FROM zb),
zs AS (SELECT s.instrument, s.i, side, max((CASE WHEN s.i >= rt THEN 4 WHEN s.i >= bk THEN 3 ELSE 1 END, confirm)) AS best, max((s.i = bk)::INT) AS broke, max((s.i = rt)::INT) AS back, arg_max((hi - lo) / atrx, head) FILTER (s.i = rt) AS width FROM s JOIN zr ON zr.instrument = s.instrument AND s.i >= head AND s.i < until GROUP BY ALL)
"""

SQL |= {
    "fvg": frame(RECURSIVE, PIVOTS + GAPS + ZONES, recursive=True, select="""SELECT s.instrument, t, CAST(u.head IS NOT NULL AS BIGINT) AS fvg_bull, CAST(d.head IS NOT NULL AS BIGINT) AS fvg_bear, u.lo AS fvg_bull_low, u.hi AS fvg_bull_high, d.hi AS fvg_bear_high, d.lo AS fvg_bear_low, round(coalesce(u.size, d.size), 6) AS fvg_size_atr,
      coalesce(u.confirm, -1) AS fvg_bull_confirm_idx, coalesce(d.confirm, -1) AS fvg_bear_confirm_idx, CAST(coalesce(u.confirm, d.confirm) - s.i AS DOUBLE) AS fvg_confirm_delay, round(coalesce(u.ba, d.ba), 6) AS fvg_mid_body_atr, CAST(coalesce(u.bos, 0) AS BIGINT) AS fvg_bos_bull, CAST(coalesce(d.bos, 0) AS BIGINT) AS fvg_bos_bear
      FROM s LEFT JOIN zn u ON u.instrument = s.instrument AND u.head = s.i AND u.side = 'u' LEFT JOIN zn d ON d.instrument = s.instrument AND d.head = s.i AND d.side = 'd'"""),
    "ifvg": frame(RECURSIVE, PIVOTS + GAPS + ZONES, recursive=True, select=f"""SELECT s.instrument, t, CAST(coalesce(d.back, 0) AS BIGINT) AS ifvg_bull, CAST(coalesce(u.back, 0) AS BIGINT) AS ifvg_bear, round(coalesce(d.width, u.width), 6) AS ifvg_width_atr, {', '.join(f"CAST(coalesce({x}.broke, 0) AS BIGINT) AS ifvg_{n}_{c}" for c in ('break', 'candidate') for n, x in (('bull', 'd'), ('bear', 'u')))},
      CAST(coalesce(d.back, 0) AS BIGINT) AS ifvg_bull_retest, CAST(coalesce(u.back, 0) AS BIGINT) AS ifvg_bear_retest, CAST(coalesce(d.best[1], 0) AS BIGINT) AS ifvg_state_bull, CAST(coalesce(u.best[1], 0) AS BIGINT) AS ifvg_state_bear, CAST(coalesce(d.best[2], -1) AS BIGINT) AS ifvg_origin_idx_bull, CAST(coalesce(u.best[2], -1) AS BIGINT) AS ifvg_origin_idx_bear
      FROM s LEFT JOIN zs u ON u.instrument = s.instrument AND u.i = s.i AND u.side = 'u' LEFT JOIN zs d ON d.instrument = s.instrument AND d.i = s.i AND d.side = 'd'"""),
}

# With room for all gaps and blocks none is pushed out, so what becomes of each is a join of zones and bars.
FILLS = """
, fa AS (SELECT z.instrument, side, head, confirm, s.i, least(greatest(CASE WHEN side = 'u' THEN hi - low ELSE high - lo END, 0) / (hi - lo), 1) AS p FROM zn z JOIN s ON s.instrument = z.instrument AND s.i > confirm),
fb AS (SELECT *, max(p) OVER (PARTITION BY instrument, side, head ORDER BY i) AS pm, coalesce(max(p) OVER (PARTITION BY instrument, side, head ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1 AS alive FROM fa),
fc AS (SELECT instrument, side, i, max((p > 0)::INT) AS touched, max((p > 0 AND p < 1)::INT) AS part, max((p >= 1)::INT) AS whole, max(pm) FILTER (p < 1) AS best, arg_max((i - confirm)::DOUBLE, (pm, -head)) FILTER (p < 1) AS age FROM fb WHERE alive GROUP BY ALL)
"""
RETESTS = """
, oz AS (SELECT instrument, i AS k, 'u' AS side, open AS hi, low AS lo FROM oe WHERE u = 1 UNION ALL SELECT instrument, i, 'd', high, open FROM oe WHERE d = 1),
ol AS (SELECT *, (SELECT min(i) FROM s WHERE s.instrument = oz.instrument AND i > k AND CASE WHEN side = 'u' THEN low <= hi ELSE high >= lo END) AS rt, (SELECT min(i) FROM s WHERE s.instrument = oz.instrument AND i > k AND CASE WHEN side = 'u' THEN low < lo ELSE high > hi END) AS dead FROM oz)
"""

SQL |= {
    "fvg_fill_all": frame(RECURSIVE, PIVOTS + GAPS + ZONES + FILLS, recursive=True, select=f"""SELECT s.instrument, t, (u.best IS NOT NULL)::BIGINT AS fvg_active_bull, (d.best IS NOT NULL)::BIGINT AS fvg_active_bear, round(CASE WHEN u.best >= coalesce(d.best, -1) THEN u.best ELSE d.best END, 6) AS fvg_fill_pct,
      CASE WHEN u.best >= coalesce(d.best, -1) THEN u.age ELSE d.age END AS fvg_age, {', '.join(f"round({x}.best, 6) AS fvg_fill_pct_{n}, {x}.age AS fvg_age_{n}, coalesce({x}.touched, 0)::BIGINT AS fvg_touched_{n}, coalesce({x}.part, 0)::BIGINT AS fvg_partial_{n}, coalesce({x}.whole, 0)::BIGINT AS fvg_full_{n}, 0::BIGINT AS fvg_invalid_{n}" for x, n in (('u', 'bull'), ('d', 'bear')))}
      FROM s LEFT JOIN fc u ON u.instrument = s.instrument AND u.i = s.i AND u.side = 'u' LEFT JOIN fc d ON d.instrument = s.instrument AND d.i = s.i AND d.side = 'd'"""),
    "ob_mitigation_all": frame(RECURSIVE, PIVOTS + BLOCKS + RETESTS, recursive=True, select="""SELECT s.instrument, t, coalesce(max((side = 'u' AND s.i >= k AND s.i < coalesce(dead, 1000000000))::INT), 0)::BIGINT AS ob_unmitigated_bull, coalesce(max((side = 'd' AND s.i >= k AND s.i < coalesce(dead, 1000000000))::INT), 0)::BIGINT AS ob_unmitigated_bear,
      coalesce(max((s.i = rt)::INT), 0)::BIGINT AS ob_first_retest FROM s LEFT JOIN ol ON ol.instrument = s.instrument GROUP BY s.instrument, t"""),
}

# Bars that reach the extreme of the five before them, every second one of neighbours.
CAUSAL = """
c0 AS (SELECT *, high >= max(high) OVER p AS h0, low <= min(low) OVER p AS l0 FROM b WINDOW p AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
c1 AS (SELECT instrument, i, FALSE AS h1, FALSE AS l1 FROM c0 WHERE i = 0 UNION ALL SELECT c0.instrument, c0.i, coalesce(h0, FALSE) AND NOT c1.h1, coalesce(l0, FALSE) AND NOT c1.l1 FROM c1 JOIN c0 ON c0.instrument = c1.instrument AND c0.i = c1.i + 1),
sl AS (SELECT c0.*, CAST(h1 AS INT) AS sh, CAST(l1 AS INT) AS sl FROM c0 JOIN c1 USING (instrument, i))
"""

# Swings of half an ATR at least, in order each that is more than six bars after the last taken.
APART = SWINGS.replace("sw AS (", "w0 AS (", 1).replace(
    "), sl AS (",
    """), w1 AS (
  SELECT *, CASE WHEN sh = 1 AND (high - greatest(hb, ha)) / atrx >= 0.5 THEN 1 ELSE 0 END AS good_high, CASE WHEN sl = 1 AND (least(lb, la) - low) / atrx >= 0.5 THEN 1 ELSE 0 END AS good_low FROM w0
), w2 AS (
  SELECT instrument, i, 0 AS kh, 0 AS kl, -1000000 AS jh, -1000000 AS jl FROM w1 WHERE i = 0
  UNION ALL
  SELECT w1.instrument, w1.i, CASE WHEN good_high = 1 AND w1.i - jh > 6 THEN 1 ELSE 0 END, CASE WHEN good_low = 1 AND w1.i - jl > 6 THEN 1 ELSE 0 END, CASE WHEN good_high = 1 AND w1.i - jh > 6 THEN w1.i ELSE jh END, CASE WHEN good_low = 1 AND w1.i - jl > 6 THEN w1.i ELSE jl END
  FROM w2 JOIN w1 ON w1.instrument = w2.instrument AND w1.i = w2.i + 1
), sw AS (SELECT w1.* EXCLUDE (sh, sl), kh AS sh, kl AS sl FROM w1 JOIN w2 ON w2.instrument = w1.instrument AND w2.i = w1.i), sl AS (""",
    1,
)

# Without displacement columns no break counts as manipulation.
PLAIN = ", d2 AS (SELECT *, CAST(sign(close - open) AS BIGINT) AS dir, FALSE AS on_ FROM s)"

DIVERGENCE = f"""
, dv AS (SELECT *, CASE WHEN sh = 1 AND high > last_value(CASE WHEN sh = 1 THEN high END IGNORE NULLS) {P1} THEN 1 ELSE 0 END AS nh, CASE WHEN sl = 1 AND low < last_value(CASE WHEN sl = 1 THEN low END IGNORE NULLS) {P1} THEN 1 ELSE 0 END AS nl FROM sl),
dw AS (SELECT *, last_value(CASE WHEN sh = 1 THEN nh END IGNORE NULLS) {RUN} AS oh, last_value(CASE WHEN sl = 1 THEN nl END IGNORE NULLS) {RUN} AS ol FROM dv)
"""

# Pullbacks are counted from one break to the next; a broken level is open for twenty bars, or to the next break.
PULLBACKS = BREAKS.format(of="sl") + f"""
, ka AS (SELECT *, sum(greatest(bb, bx)) {RUN} AS id, last_value(CASE WHEN bb = 1 THEN 1 WHEN bx = 1 THEN -1 END IGNORE NULLS) {RUN} AS dr, CASE WHEN bb = 1 THEN i - lhi WHEN bx = 1 THEN i - lli END AS ag FROM bs),
kb AS (SELECT *, CASE WHEN id > 0 AND greatest(bb, bx) = 0 AND CASE WHEN dr = 1 THEN close < open ELSE close > open END THEN 1 ELSE 0 END AS back FROM ka),
kc AS (SELECT *, sum(back) OVER w AS n, max(ag) OVER w AS broken FROM kb WINDOW w AS (PARTITION BY instrument, id ORDER BY i ROWS UNBOUNDED PRECEDING)),
ke AS (SELECT instrument, i AS i0, CASE WHEN bb = 1 THEN 1 ELSE -1 END AS side, CASE WHEN bb = 1 THEN lh ELSE ll END AS lv, least(i + 20, coalesce(lead(i) OVER (PARTITION BY instrument ORDER BY i), i + 20)) AS i1 FROM bs WHERE bb = 1 OR bx = 1),
kh AS (SELECT ke.instrument, i0, side, min(i) AS i FROM ke JOIN bs ON bs.instrument = ke.instrument AND i > i0 AND i <= i1 AND CASE WHEN side = 1 THEN low < lv AND close > lv ELSE high > lv AND close < lv END GROUP BY ALL)
"""

SQL |= {
    "higher_timeframe": frame(CAUSAL + TREND, "lo AS (SELECT instrument, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS t, arg_max(price, (ts, event_id)) AS close FROM walk GROUP BY ALL)", seconds=14400, recursive=True,
                              select="SELECT lo.instrument, lo.t, lo.close, tt.close AS htf_close, CAST(tt.st AS BIGINT) AS htf_trend_state FROM lo ASOF LEFT JOIN tt ON tt.instrument = lo.instrument AND lo.t >= tt.t + 14400"),
    "smt_divergence": frame(RECURSIVE, SWINGS + DIVERGENCE, recursive=True, select=f"SELECT a.instrument, a.t, {flag('a.nh = 1 AND o.ol = 0', 'smt_bearish')}, {flag('a.nl = 1 AND o.oh = 0', 'smt_bullish')} FROM dw a LEFT JOIN (SELECT t, oh, ol FROM dw WHERE instrument = 'purchase') o ON o.t = a.t WHERE a.instrument = 'click'"),
    "setup_gated": swinging("close, CAST(rg AS BIGINT) AS regime, CAST(CASE WHEN hr < 13 THEN 1 WHEN hr < 17 THEN 3 ELSE 2 END AS BIGINT) AS session", TREND + REGIME + f", rd AS (SELECT *, {HOUR} AS hr FROM rc WHERE rg IN (1, 2) AND {HOUR} BETWEEN 8 AND 21)", "rd"),
    "setup_pullbacks": frame(RECURSIVE, SWINGS + PULLBACKS, recursive=True, select=f"SELECT kc.instrument, kc.t, {flag('back = 1 AND n = 1 AND broken >= 5', 'is_first_pullback_after_bos')}, CAST(coalesce(kh.side, 0) AS BIGINT) AS bos_level_swept FROM kc LEFT JOIN kh ON kh.instrument = kc.instrument AND kh.i = kc.i"),
    "candles_loaded": frame(select=f"SELECT instrument, t, {PRICES}, volume FROM candles WHERE t >= 1704412800"),
    "stream_phases": SQL["amd_state"],
    "swings_apart": frame(RECURSIVE, APART, recursive=True, select=f"SELECT instrument, t, {swing_columns()} FROM sl"),
    "amd_engine": frame(RECURSIVE + PLAIN + LOOSE + PHASES, recursive=True, select=f"SELECT instrument, t, {FEATURE_COLUMNS}, {PHASE_COLUMNS}, {LABEL_COLUMNS} FROM lc"),
}

# The same columns, computed in chunks.
SQL |= {f"chunked_{n}": SQL[n] for n in ("emas", "atr", "adx", "rsi", "macd", "bb_width", "swings", "trend_state", "bos", "choch", "volume_ratio", "rolling_atr_ratio")}
SQL |= {"ifvg_relational": SQL["ifvg"], "landing_read": SQL["bars_hourly"], "pivots_bucketed": SQL["pivots"]}
