"""Snapshots, books, marks, alerts, sinks and user functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import structure as SC
from barloom.catalog.bars import OHLCV, OHLCV_SQL, group_sql
from barloom.catalog.base import bars, floor_sql, over, q, query, r, tidy
from barloom.catalog.indicators import (
    BOLL, MFI, MFI_VALUE, P, STOCH, adx_ctes, atr_ctes, ema_sql, lag, rows, rsi_ctes, rsi_value, scan_sql,
)
from barloom.catalog.patterns import facts_sql
from barloom.catalog.signals import DON_ACT, account_sql, st_ctes
from barloom.catalog.structure import pivots_sql
from barloom.operators import backtest as B
from barloom.operators import books as K
from barloom.operators import custom as U
from barloom.operators import indicators as I
from barloom.operators import marks as M
from barloom.operators import mtf_zones as Y
from barloom.operators import patterns as KP
from barloom.operators import resample as R
from barloom.operators import reversals as V
from barloom.operators import sinks as W
from barloom.operators import snapshot as S
from barloom.operators import positioning as O
from barloom.plans.blocks import frame
from barloom.sources import flows
from barloom.sources.bars import table

c = F.col
h2 = lambda x, d=2: f"(floor(({x}) * {10.0**d} + 0.5) / {10.0**d})"

MACD = f"""me AS (SELECT *, {ema_sql(12)} AS fb, {ema_sql(26)} AS sb FROM b), {scan_sql('my', 'me', {'f': (1 - 2 / 13, 'fb'), 's': (1 - 2 / 27, 'sb')})},
ml AS (SELECT symbol, rn, CASE WHEN rn >= 26 THEN f - s END AS line FROM my), mg AS (SELECT *, {ema_sql(9, 'line', first=26)} AS gb FROM ml), {scan_sql('mz', 'mg', {'v': (1 - 2 / 10, 'gb')})}"""
ALL18 = f"""{rsi_ctes(6, '6')}, {rsi_ctes(7, '7')}, {rsi_ctes(12, '12')}, {rsi_ctes(14, '14')}, {STOCH}, {adx_ctes()}, {MACD}, {MFI}, {BOLL},
k1 AS (SELECT b.symbol, b.rn, {rsi_value(7, 'rs7')} AS x FROM rs7 JOIN b USING (symbol, rn)), k2 AS (SELECT *, sum(CASE WHEN x < 30 THEN 0 ELSE 1 END) {P}) AS ga FROM k1),
k3 AS (SELECT symbol, rn, sum(CASE WHEN x < 30 THEN 30 - x ELSE 0 END) OVER (PARTITION BY symbol, ga ORDER BY rn) AS cum FROM k2),
al AS (SELECT b.symbol, b.time, b.rn, b.n, b.close, {rsi_value(14, 'rs14')} AS rsi14, {rsi_value(7, 'rs7')} AS rsi7, cum AS rsi_cum_diff, {rsi_value(6, 'rs6')} AS rsi6, {rsi_value(12, 'rs12')} AS rsi12,
  s4.k AS stoch_k, s4.dd AS stoch_d, CASE WHEN b.rn >= 28 THEN da.a END AS adx, dx.pdi AS plus_di, dx.mdi AS minus_di, ml.line AS macd, CASE WHEN b.rn >= 34 THEN mz.v END AS macd_signal, CASE WHEN b.rn >= 34 THEN ml.line - mz.v END AS macd_hist,
  {MFI_VALUE.replace('rn <', 'b.rn <')} AS mfi14, CASE WHEN b.rn >= 20 THEN mid + 2 * sd END AS bb_upper, CASE WHEN b.rn >= 20 THEN mid END AS bb_middle, CASE WHEN b.rn >= 20 THEN mid - 2 * sd END AS bb_lower
  FROM b JOIN rs6 USING (symbol, rn) JOIN rs7 USING (symbol, rn) JOIN rs12 USING (symbol, rn) JOIN rs14 USING (symbol, rn) JOIN s4 USING (symbol, rn) JOIN da USING (symbol, rn) JOIN dx USING (symbol, rn) JOIN ml USING (symbol, rn) JOIN mz USING (symbol, rn)
  JOIN f3 USING (symbol, rn) JOIN bo USING (symbol, rn) JOIN k3 USING (symbol, rn))"""
DIGITS = {k: min(v, 3) for k, v in S.SERIES.items()}


# Compared at the reported precision; the SQL rounds half up the same way.
@query("regime_series", over(f", {ALL18} SELECT symbol, time, {', '.join(f'{h2(k, v)} AS {k}' for k, v in S.SERIES.items() if k != 'rsi_diff')}, {h2('rsi6 - rsi12')} AS rsi_diff FROM al", "hourly", True))
def _(spark, d):
    df = S.regime_series(bars(spark, d, "hourly"))
    return df.select("symbol", c("time").cast("timestamp_ntz").alias("time"), *S.SERIES)


rd = lambda x, d=2: f"(round({x}, {d}) + 0.0)"
SNAP_COLS = ("rsi14", "stoch_k", "stoch_d", "adx", "plus_di", "minus_di", "macd", "macd_signal", "macd_hist", "mfi14", "bb_upper", "bb_middle", "bb_lower")
SNAP = f"""{ALL18}, {atr_ctes(14, '14')}, {st_ctes(60, 4.0)}, ee AS (SELECT *, {ema_sql(20)} AS eb FROM b), {scan_sql('ey', 'ee', {'v': (1 - 2 / 21, 'eb')})},
av AS (SELECT symbol, rn, {lag('close')} AS pc, {', '.join(f"CASE WHEN rn >= {w} THEN avg(close) {rows(w)} END AS sma{w}" for w in (20, 50, 200))}, {', '.join(f"list(close) {rows(w)} AS h{w}" for w in (60, 100, 200))} FROM b),
z0 AS (SELECT al.*, aw14.a AS atr, ey.v AS ema, st.down, CASE WHEN st.down THEN st.upper ELSE st.lower END AS stv, pc, sma20, sma50, sma200,
  {', '.join(f"CASE WHEN n >= {w} THEN list_sum(list_transform(range(1, {w + 1}), lambda k: k * h{w}[k])) / {w * (w + 1) // 2} END AS wma{w}" for w in (60, 100, 200))}
  FROM al JOIN aw14 USING (symbol, rn) JOIN ey USING (symbol, rn) LEFT JOIN st USING (symbol, rn) JOIN av USING (symbol, rn) WHERE rn = n),
z AS (SELECT symbol, n AS bars, time AS last_time, close, {', '.join(f"{rd(k, S.LAST[k])} AS {k}" for k in SNAP_COLS)}, {rd('atr', 4)} AS atr14, {rd('ema', 4)} AS ema20, {rd('stv')} AS st_value, CASE WHEN down THEN 'bearish' ELSE 'bullish' END AS st_direction,
  {', '.join(f"{rd(x, 4)} AS {x}" for x in ('sma20', 'sma50', 'sma200', 'wma60', 'wma100', 'wma200'))}, {rd('(close - pc) / pc * 100')} AS change_pct FROM z0)"""


def band_sql(v, lo, hi, words):
    return f"CASE WHEN {v} < {lo} THEN '{words[0]}' WHEN {v} > {hi} THEN '{words[2]}' WHEN {v} IS NOT NULL THEN '{words[1]}' END"


def side_sql(kind, windows):
    pick = lambda op: "concat_ws('/', " + ", ".join(f"CASE WHEN close {op} {kind}{w} THEN '{w}' END" for w in windows) + ")"
    return f"concat_ws(', ', CASE WHEN {pick('>=')} <> '' THEN 'above ' || {pick('>=')} END, CASE WHEN {pick('<')} <> '' THEN 'below ' || {pick('<')} END)"


AVERAGES = ("sma20", "sma50", "sma200", "ema20", "wma60", "wma100", "wma200", "bb_upper", "bb_middle", "bb_lower")
HEAT = ("oversold", "neutral", "overbought")
SNAP_OUT = ("symbol", "bars", "last_time", "close", *SNAP_COLS, "atr14", "ema20", "st_value", "st_direction", "sma20", "sma50", "sma200", "wma60", "wma100", "wma200", "change_pct")


@query("regime_snapshot", over(f""", {SNAP} SELECT {', '.join(f'{q(x, 3)} AS {x}' if x in AVERAGES else x for x in SNAP_OUT)}, {band_sql('rsi14', 30, 70, HEAT)} AS rsi_state, {band_sql('stoch_k', 20, 80, HEAT)} AS stoch_state, {band_sql('adx', 20, 25, ('no trend', 'developing trend', 'trending'))} AS adx_state,
  {band_sql('mfi14', 20, 80, HEAT)} AS mfi_state, CASE WHEN macd = macd_signal THEN 'flat' WHEN macd_signal IS NOT NULL THEN CASE WHEN macd > macd_signal THEN 'bullish' ELSE 'bearish' END || CASE WHEN abs(macd_hist) < abs(macd) * 0.05 THEN ', converging' ELSE '' END END AS macd_state,
  {side_sql('sma', (20, 50, 200))} AS ma_side, {side_sql('wma', (60, 100, 200))} AS wma_side, CASE WHEN close > bb_upper THEN 'above upper band' WHEN close < bb_lower THEN 'below lower band' WHEN bb_upper IS NOT NULL THEN 'inside bands' END AS bb_state FROM z""", "hourly", True))
def _(spark, d):
    df = S.regime_snapshot(bars(spark, d, "hourly"))
    # Averages of short decimals hit exact ties at four digits, so they are compared at three.
    shown = {"last_time": c("last_time").cast("timestamp_ntz")} | {x: r(x, 3) for x in AVERAGES}
    return df.select(*[shown.get(x, c(x)).alias(x) for x in SNAP_OUT], "rsi_state", "stoch_state", "adx_state", "mfi_state", "macd_state", "ma_side", "wma_side", "bb_state")


# ---- closed higher timeframes ----------------------------------------------------------------

H4 = f"""g AS ({group_sql(floor_sql(14400, 'time'))}), en AS (SELECT symbol, max(time) AS e FROM b GROUP BY symbol),
hc AS MATERIALIZED (SELECT g.symbol, bucket AS time, bucket + INTERVAL 4 HOUR AS close_time, open, high, low, close, row_number() OVER (PARTITION BY g.symbol ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY g.symbol) AS n FROM g JOIN en USING (symbol) WHERE bucket + INTERVAL 4 HOUR <= e + INTERVAL 1 HOUR)"""


@query("asof_htf_closed", over(f", {H4} SELECT b.symbol, b.time, {q('h.close')} AS htf_close FROM b ASOF LEFT JOIN hc h ON b.symbol = h.symbol AND b.time + INTERVAL 1 HOUR >= h.close_time", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly")
    return tidy(K.htf_closed(b, R.resample_htf(b, 14400, 3600), {"htf_close": "close"}, 3600), "symbol", "time", "htf_close")


@query("ema1h_trend", over(f""", g AS ({group_sql(floor_sql(3600, 'time'))}), en AS (SELECT symbol, max(time) AS e FROM b GROUP BY symbol),
hc AS MATERIALIZED (SELECT g.symbol, bucket + INTERVAL 1 HOUR AS close_time, close, row_number() OVER (PARTITION BY g.symbol ORDER BY bucket) AS rn FROM g JOIN en USING (symbol) WHERE bucket + INTERVAL 1 HOUR <= e + INTERVAL 15 MINUTE),
hb AS (SELECT *, CASE WHEN rn = 1 THEN close ELSE close * {2 / 22!r} END AS eb FROM hc), {scan_sql('hy', 'hb', {'v': (1 - 2 / 22, 'eb')})},
hz AS (SELECT symbol, close_time, v FROM hy JOIN hc USING (symbol, rn)),
x AS (SELECT b.symbol, b.time, b.rn, h.v AS ema1h FROM b ASOF LEFT JOIN hz h ON b.symbol = h.symbol AND b.time + INTERVAL 15 MINUTE >= h.close_time)
SELECT symbol, time, {q('ema1h')} AS ema1h, coalesce(ema1h > {lag('ema1h', 4)}, false) AS trend_up FROM x""", "quarter", True))
def _(spark, d):
    return tidy(K.ema1h_trend(bars(spark, d, "quarter"), 900), "symbol", "time", "ema1h", "trend_up")


DAYMA = f"""g AS ({group_sql("date_trunc('day', time)")}), hm AS (SELECT symbol, bucket::TIMESTAMP AS bucket, row_number() OVER w AS k, avg(close) OVER (PARTITION BY symbol ORDER BY bucket ROWS 4 PRECEDING) AS ma FROM g WINDOW w AS (PARTITION BY symbol ORDER BY bucket))"""


@query("htf_ma_step", over(f""", {DAYMA}, hk AS (SELECT symbol, bucket, bucket + INTERVAL 1 DAY AS close_time, CASE WHEN k >= 5 THEN ma END AS ma FROM hm)
SELECT 'known' AS mode, b.symbol, b.time, {q('h.ma')} AS htf_ma FROM b ASOF LEFT JOIN hk h ON b.symbol = h.symbol AND b.time + INTERVAL 1 HOUR >= h.close_time
UNION ALL SELECT 'repaint', b.symbol, b.time, {q('h.ma')} FROM b JOIN hk h ON b.symbol = h.symbol AND date_trunc('day', b.time) = h.bucket""", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly")
    known = K.htf_ma_step(b, "D", 5).withColumn("mode", F.lit("known"))
    paint = K.htf_ma_step(b, "D", 5, as_known=False).withColumn("mode", F.lit("repaint"))
    return tidy(known.unionByName(paint, allowMissingColumns=True), "mode", "symbol", "time", "htf_ma")


@query("htf_levels", over(f""", {H4}, {SC.pivots_sql('hc', 3, 3, True, False)},
pk AS (SELECT pv.symbol, pv.kind, pv.price, pv.time, pv.rn, h.close_time AS known, row_number() OVER (PARTITION BY pv.symbol, kind ORDER BY pv.rn DESC) AS age FROM pv JOIN hc h ON h.symbol = pv.symbol AND h.rn = pv.rn + 3),
a AS (SELECT p.*, o.price AS prev_px FROM pk p LEFT JOIN pk o ON o.symbol = p.symbol AND o.kind = p.kind AND o.age = 2 WHERE p.age = 1),
s AS (SELECT a.symbol, a.kind, min(b.time) AS seen FROM a JOIN b ON b.symbol = a.symbol AND b.time + INTERVAL 1 HOUR >= known GROUP BY ALL)
SELECT a.symbol, CASE a.kind WHEN 'high' THEN 'R' ELSE 'S' END AS side, {q('a.price')} AS px, a.time AS pivot_time, {q('prev_px')} AS prev_px, seen,
  seen IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol AND b.time > seen AND CASE a.kind WHEN 'high' THEN b.close > a.price ELSE b.close < a.price END) AS active FROM a LEFT JOIN s ON s.symbol = a.symbol AND s.kind = a.kind""", "hourly"))
def _(spark, d):
    return tidy(K.htf_levels(bars(spark, d, "hourly"), 240, 3600), "symbol", "side", "px", "pivot_time", "prev_px", "seen", "active")


# ---- books (path-dependent; checked in the tests) --------------------------------------------


def oi_of(spark, d):
    h = flows.deriv_history(spark, d).select("symbol", "time", "oi")
    return O.oi_on_bars(bars(spark, d, "hourly").select("symbol", "timeframe", "time"), h, 3600)


# Reversal points by a recursion over bars that carries both followers, bar by bar.
_TURN = lambda way, px, least: f"(CASE WHEN {px} = 0 THEN CASE WHEN CASE {way} WHEN 1 THEN {px} > low ELSE high > {px} END THEN 1e300 ELSE 0 END ELSE CASE {way} WHEN 1 THEN {px} - low ELSE high - {px} END / {px} END >= {least})"
_GROW = lambda way, px: f"(CASE {way} WHEN 1 THEN high >= {px} ELSE low <= {px} END)"
_AHEAD, _BEHIND = (lambda way: f"CASE {way} WHEN 1 THEN high ELSE low END"), (lambda way: f"CASE {way} WHEN 1 THEN low ELSE high END")
DERIV_ROWS = f"SELECT symbol, time, sum(vol) OVER (PARTITION BY symbol ORDER BY time) AS oi FROM (SELECT event_type AS symbol, {floor_sql(900)} AS time, sum(value) AS vol FROM events GROUP BY ALL)"
REV_IN = f""",
g1 AS (SELECT symbol, rn, close, CASE WHEN rn = 1 THEN close ELSE close * {2 / 22!r} END AS eb FROM b), {scan_sql('e1', 'g1', {'v': (1 - 2 / 22, 'eb')})},
{atr_ctes(14)}, {rsi_ctes(14)}, {BOLL},
dh AS (SELECT symbol, time, oi FROM DH), oo AS (SELECT b.symbol, b.rn, CASE WHEN b.time + INTERVAL 1 HOUR - h.time <= INTERVAL 70 MINUTE THEN h.oi END AS bar_oi FROM b ASOF LEFT JOIN (SELECT * FROM dh WHERE oi > 0) h ON b.symbol = h.symbol AND b.time + INTERVAL 1 HOUR >= h.time),
r1 AS (SELECT b.*, e1.v > {lag('e1.v')} AS up_, CASE WHEN b.rn >= 14 THEN aw.a END AS atr, {rsi_value(14, 'rs', True)} AS rsi, oo.bar_oi FROM b JOIN e1 USING (symbol, rn) JOIN aw USING (symbol, rn) JOIN rs USING (symbol, rn) JOIN oo USING (symbol, rn)),
r2 AS (SELECT *, CASE WHEN rn >= 20 THEN volume / nullif(avg(volume) {rows(20)}, 0) END AS vr, CASE WHEN rn >= 24 THEN max(high) {rows(24)} END AS h24, CASE WHEN rn >= 24 THEN min(low) {rows(24)} END AS l24,
  CASE WHEN rn >= 12 THEN max(high) {rows(12)} END AS h12, CASE WHEN rn >= 12 THEN min(low) {rows(12)} END AS l12, 100 * (bar_oi - {lag('bar_oi')}) / nullif({lag('bar_oi')}, 0) AS oic, {lag('close', 6)} AS c6 FROM r1),
r3 AS MATERIALIZED (SELECT *, coalesce(up_, false) AS up1, coalesce(high >= {lag('h24', 7)} - 0.7 * atr, false) AS tt, coalesce(low <= {lag('l24', 7)} + 0.7 * atr, false) AS tl, coalesce(high >= h12, false) AS xt, coalesce(low <= l12, false) AS xl,
  coalesce(close - c6 < 0.3 * atr, false) AS st, coalesce(c6 - close < 0.3 * atr, false) AS sl,
  coalesce(({lag('vr', 1)} + {lag('vr', 2)} + {lag('vr', 3)} + {lag('vr', 4)}) / 4 <= 0.7 AND vr >= 4 AND abs(close - open) >= 1.2 * atr, false) AS bu FROM r2),
fl AS (SELECT symbol, 0::BIGINT AS rn, 1 AS fw, high AS fp, 1::BIGINT AS fa, NULL::BIGINT AS ta, 1 AS bw, high AS bp, 1::BIGINT AS ba, NULL::BIGINT AS n1, NULL::BIGINT AS n2, -99::BIGINT AS lc, false AS ft, NULL::BIGINT AS oa, NULL::BIGINT AS ota, NULL::BIGINT AS on1, NULL::BIGINT AS on2, false AS bt, NULL::BIGINT AS oba, false AS fire FROM r3 WHERE rn = 1
  UNION ALL SELECT i.symbol, i.rn, CASE WHEN f2 THEN -fw ELSE fw END, CASE WHEN f2 THEN {_BEHIND('fw')} ELSE fp1 END, CASE WHEN f2 THEN i.rn ELSE fa1 END, CASE WHEN f2 AND fw = 1 THEN fa1 ELSE ta END,
    CASE WHEN b2 THEN -bw ELSE bw END, CASE WHEN b2 THEN {_BEHIND('bw')} ELSE bp1 END, CASE WHEN b2 THEN i.rn ELSE ba1 END, CASE WHEN b2 AND bw = -1 THEN n2 ELSE n1 END, CASE WHEN b2 AND bw = -1 THEN ba1 ELSE n2 END,
    CASE WHEN bu AND i.rn - lc >= 6 THEN i.rn ELSE lc END, f2, fa1, ta, n1, n2, b2, ba1, bu AND i.rn - lc >= 6
  FROM fl s JOIN r3 i ON i.symbol = s.symbol AND i.rn = s.rn + 1, LATERAL (SELECT CASE WHEN {_GROW('fw', 'fp')} THEN {_AHEAD('fw')} ELSE fp END AS fp1, CASE WHEN {_GROW('fw', 'fp')} THEN i.rn ELSE fa END AS fa1, CASE WHEN {_GROW('bw', 'bp')} THEN {_AHEAD('bw')} ELSE bp END AS bp1, CASE WHEN {_GROW('bw', 'bp')} THEN i.rn ELSE ba END AS ba1),
  LATERAL (SELECT {_TURN('fw', 'fp1', 0.007)} AS f2, {_TURN('bw', 'bp1', 0.02)} AS b2)),
fm AS MATERIALIZED (SELECT *, lag(fw) OVER (PARTITION BY symbol ORDER BY rn) AS fw0, lag(bw) OVER (PARTITION BY symbol ORDER BY rn) AS bw0 FROM fl),
pt AS (SELECT symbol, rn, 'fine' AS kind, oa AS at_rn, fw0 = 1 AS is_top, ota AS pa, on1 AS n1, on2 AS n2 FROM fm WHERE ft UNION ALL SELECT symbol, rn, 'big', oba, bw0 = 1, NULL, NULL, NULL FROM fm WHERE bt
  UNION ALL SELECT m.symbol, m.rn, 'burst', m.rn, NOT close >= open, NULL, NULL, NULL FROM fm m JOIN r3 USING (symbol, rn) WHERE fire UNION ALL SELECT m.symbol, m.rn, 'candidate', fa, fw = 1, NULL, m.n1, m.n2 FROM fm m JOIN r3 ON r3.symbol = m.symbol AND r3.rn = m.rn WHERE m.rn = n),
pr AS (SELECT p.symbol, p.rn, i.time, p.kind, p.at_rn, p.is_top, CASE WHEN p.is_top THEN x.high ELSE x.low END AS price, i.close AS cl, i.atr, i.up1, x.vr, x.oic, x.rsi, CASE WHEN p.is_top THEN x.xt ELSE x.xl END AS ex, CASE WHEN p.is_top THEN x.st ELSE x.sl END AS stall, p.is_top AND x.tt AS touch,
  o.high AS op, o.rsi AS orsi, CASE WHEN p.n2 IS NULL THEN NULL WHEN p.n1 IS NULL OR p.n1 = p.n2 THEN y2.low ELSE y1.low + (y2.low - y1.low) * (p.at_rn - p.n1) / (p.n2 - p.n1) END AS line
  FROM pt p JOIN r3 i ON i.symbol = p.symbol AND i.rn = p.rn JOIN r3 x ON x.symbol = p.symbol AND x.rn = p.at_rn LEFT JOIN r3 o ON o.symbol = p.symbol AND o.rn = p.pa LEFT JOIN r3 y1 ON y1.symbol = p.symbol AND y1.rn = p.n1 LEFT JOIN r3 y2 ON y2.symbol = p.symbol AND y2.rn = p.n2),
rv AS MATERIALIZED (SELECT *, kind IN ('fine', 'candidate') AS fk, CASE WHEN is_top THEN coalesce(oic >= 0.3, false) ELSE coalesce(oic <= -0.25, false) END AS moved FROM pr)""".replace("FROM DH)", f"FROM ({DERIV_ROWS}))")
REV_NEED = "(0.007 - CASE WHEN price = 0 THEN CASE WHEN (price - cl) * CASE WHEN is_top THEN 1 ELSE -1 END > 0 THEN 'Infinity'::DOUBLE ELSE 0 END ELSE (price - cl) * CASE WHEN is_top THEN 1 ELSE -1 END / price END) * 100"
REV_STARS = "(coalesce(vr >= 2, false)::INT + touch::INT + moved::INT + ex::INT)::BIGINT"
REV_TAG = "CASE WHEN is_top AND coalesce(vr < 1.5, false) AND stall THEN 'B' WHEN NOT is_top AND coalesce(vr >= 2, false) THEN 'A' ELSE '' END"


@query("rev_point", over(f"""{REV_IN}
SELECT symbol, '1h' AS timeframe, rn, time, kind, at_rn, {q('price')} AS price, is_top, CASE WHEN fk THEN {REV_STARS} END AS stars, CASE WHEN kind = 'fine' THEN {REV_TAG} ELSE '' END AS tag,
  kind = 'fine' AND is_top AND coalesce(price > op AND rsi < orsi - 2, false) AS bear_div, fk AND NOT is_top AND coalesce(abs(price - line) <= 0.5 * atr, false) AS touch_trend,
  CASE WHEN is_top THEN NOT up1 ELSE up1 END AS with_trend, CASE WHEN kind <> 'big' THEN {q('vr')} END AS vol_ratio, CASE WHEN fk THEN {q('rsi')} END AS rsi, CASE WHEN kind = 'candidate' THEN {q(REV_NEED)} END AS need_pct FROM rv""", "hourly", True))
def _(spark, d):
    return tidy(V.rev_point(bars(spark, d, "hourly"), 3600, oi_of(spark, d)))


def _levels_sql(name: str, hours: int) -> str:
    """CTEs ending in ``{name}``: newest pivots of closed coarse bars and whether a later close went beyond."""
    t = name
    return f"""{t}g AS ({group_sql(floor_sql(hours * 3600, 'time'))}), {t}e AS (SELECT symbol, max(time) AS e FROM b GROUP BY symbol),
{t}c AS MATERIALIZED (SELECT g.symbol, bucket AS time, bucket + INTERVAL {hours} HOUR AS close_time, open, high, low, close, row_number() OVER (PARTITION BY g.symbol ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY g.symbol) AS n FROM {t}g g JOIN {t}e USING (symbol) WHERE bucket + INTERVAL {hours} HOUR <= e + INTERVAL 1 HOUR),
{SC.pivots_sql(t + 'c', 3, 3, True, False, name=t + 'p')},
{t}k AS (SELECT p.symbol, p.kind, p.price, k.close_time AS known FROM {t}p p JOIN {t}c k ON k.symbol = p.symbol AND k.rn = p.rn + 3 QUALIFY row_number() OVER (PARTITION BY p.symbol, kind ORDER BY p.rn DESC) = 1),
{t}s AS (SELECT k.symbol, k.kind, any_value(k.price) AS price, min(b.time) AS seen FROM {t}k k JOIN b ON b.symbol = k.symbol AND b.time + INTERVAL 1 HOUR >= known GROUP BY ALL),
{t} AS (SELECT symbol, max(price) FILTER (kind = 'high') AS r, max(price) FILTER (kind = 'low') AS s, coalesce(bool_or(ok) FILTER (kind = 'high'), false) AS ra, coalesce(bool_or(ok) FILTER (kind = 'low'), false) AS sa
  FROM (SELECT *, NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = s.symbol AND b.time > seen AND CASE kind WHEN 'high' THEN b.close > price ELSE b.close < price END) AS ok FROM {t}s s) GROUP BY symbol)"""


_SIDE = lambda s: f"CASE {s}.is_top WHEN true THEN 'top' WHEN false THEN 'bottom' END"


@query("rev_point_report", over(f"""{REV_IN}, {_levels_sql('lh', 1)}, {_levels_sql('lq', 4)},
nw AS (SELECT symbol, arg_max({{'is_top': is_top, 'price': price, 'stars': {REV_STARS}, 'tag': {REV_TAG}}}, rn) FILTER (kind = 'fine') AS f, arg_max({{'is_top': is_top, 'price': price}}, rn) FILTER (kind = 'big') AS g,
  arg_max({{'is_top': is_top, 'price': price, 'stars': {REV_STARS}, 'need': {REV_NEED}}}, rn) FILTER (kind = 'candidate') AS k FROM rv GROUP BY symbol)
SELECT w.symbol, '1h' AS timeframe, {_SIDE('f')} AS fine_side, {q('f.price')} AS fine_price, f.stars AS fine_stars, f.tag AS fine_tag, {_SIDE('g')} AS big_side, {q('g.price')} AS big_price, {_SIDE('k')} AS candidate_side, {q('k.price')} AS candidate_price,
  k.stars AS candidate_stars, CASE WHEN k.need > 0 THEN round(k.need, 2) END AS need_pct, CASE WHEN i.up1 THEN 'up' ELSE 'down' END AS trend_1h, round(i.oic, 2) + 0.0 AS oi_chg_1h_pct,
  {q('lh.r')} AS r_1h, {q('lh.s')} AS s_1h, coalesce(lh.ra, false) AS r_1h_active, coalesce(lh.sa, false) AS s_1h_active, {q('lq.r')} AS r_4h, {q('lq.s')} AS s_4h, coalesce(lq.ra, false) AS r_4h_active, coalesce(lq.sa, false) AS s_4h_active
FROM nw w JOIN r3 i ON i.symbol = w.symbol AND i.rn = i.n LEFT JOIN lh ON lh.symbol = w.symbol LEFT JOIN lq ON lq.symbol = w.symbol""", "hourly", True))
def _(spark, d):
    return tidy(V.rev_point_report(bars(spark, d, "hourly"), 3600, oi_of(spark, d)))


# The same zones by a recursion over breaks and a look at every later bar.
OB_TAP = "CASE z.dir WHEN 1 THEN b.low <= z.top ELSE b.high >= z.bot END"
OB_SQL = f""", {pivots_sql('b', 5, 5, True, False)},
oi AS MATERIALIZED (SELECT b.*, h.price AS ph, l.price AS pl FROM b LEFT JOIN pv h ON h.symbol = b.symbol AND h.kind = 'high' AND h.rn + 5 = b.rn LEFT JOIN pv l ON l.symbol = b.symbol AND l.kind = 'low' AND l.rn + 5 = b.rn),
bk AS (SELECT symbol, 0::BIGINT AS rn, NULL::DOUBLE AS ce, NULL::DOUBLE AS fl, 0 AS tr, NULL::INT AS way, false AS choch, NULL::DOUBLE AS sw FROM b WHERE rn = 1
  UNION ALL SELECT i.symbol, i.rn, CASE WHEN w = 1 THEN NULL ELSE c1 END, CASE WHEN w = -1 THEN NULL ELSE f1 END, coalesce(w, g.tr), w, coalesce(g.tr = -w, false), CASE w WHEN 1 THEN c1 WHEN -1 THEN f1 END
  FROM bk g JOIN oi i ON i.symbol = g.symbol AND i.rn = g.rn + 1, LATERAL (SELECT coalesce(i.ph, g.ce) AS c1, coalesce(i.pl, g.fl) AS f1),
  LATERAL (SELECT CASE WHEN close > c1 AND close < f1 THEN CASE WHEN close > open THEN 1 ELSE -1 END WHEN close > c1 THEN 1 WHEN close < f1 THEN -1 END AS w)),
bw AS MATERIALIZED (SELECT * FROM bk WHERE way IS NOT NULL),
m0 AS (SELECT symbol, rn, n, high, low, lag(high, 2) OVER k AS top, lag(low, 2) OVER k AS bot, lag(high, 3) OVER k AS h3, lag(low, 3) OVER k AS l3 FROM b WINDOW k AS (PARTITION BY symbol ORDER BY rn)),
mk AS MATERIALIZED (SELECT symbol, rn AS born, n, top, bot, CASE WHEN bot < l3 AND low > top THEN 1 ELSE -1 END AS dir FROM m0 WHERE rn >= 4 AND ((bot < l3 AND low > top) OR (top > h3 AND high < bot))),
z1 AS (SELECT z.*, max(w.rn) FILTER (w.rn <= born) AS had, min(w.rn) FILTER (w.rn > born) AS got FROM mk z LEFT JOIN bw w ON w.symbol = z.symbol AND w.way = z.dir AND w.rn BETWEEN born - 1 AND born + 20 GROUP BY ALL),
z2 AS (SELECT z.*, min(b.rn) AS ret FROM z1 z LEFT JOIN b ON b.symbol = z.symbol AND b.rn BETWEEN born + 1 AND born + 20 AND {OB_TAP} GROUP BY ALL),
z3 AS MATERIALIZED (SELECT *, greatest(born, conf) AS fresh FROM (SELECT *, coalesce(had, CASE WHEN ret IS NULL OR ret > got THEN got END) AS conf FROM z2) WHERE conf IS NOT NULL),
z4 AS MATERIALIZED (SELECT z.*, min(b.rn) AS mit FROM z3 z LEFT JOIN b ON b.symbol = z.symbol AND b.rn > fresh AND {OB_TAP} GROUP BY ALL),
z5 AS MATERIALIZED (SELECT z.*, min(b.rn) AS brk FROM z4 z LEFT JOIN b ON b.symbol = z.symbol AND b.rn >= mit AND CASE z.dir WHEN 1 THEN b.close < z.bot ELSE b.close > z.top END GROUP BY ALL),
ev AS (SELECT *, 'fresh' AS event, fresh AS rn FROM z5 UNION ALL SELECT *, 'mitigated', mit FROM z5 WHERE mit IS NOT NULL UNION ALL SELECT *, 'breaker', brk FROM z5 WHERE brk IS NOT NULL
  UNION ALL SELECT *, 'final:' || CASE WHEN brk IS NOT NULL THEN 'breaker' WHEN mit IS NOT NULL THEN 'mitigated' ELSE 'fresh' END, n FROM z5)
SELECT e.symbol, '1d' AS timeframe, e.rn, b.time, event, born - 2 AS ob_rn, dir::BIGINT AS direction, {q('top')} AS top, {q('bot')} AS bottom, w.choch, conf AS confirm_rn, {q('w.sw')} AS swing_price, CASE WHEN brk <= e.rn THEN brk END AS break_rn
FROM ev e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn JOIN bw w ON w.symbol = e.symbol AND w.rn = conf"""


@query("order_blocks", over(OB_SQL, "brand", True))
def _(spark, d):
    return tidy(K.order_blocks(bars(spark, d)))


OB_STATES = {
    "fresh_bull": "dir = 1 AND b.rn >= fresh AND NOT coalesce(b.rn >= least(mit, brk), false)", "fresh_bear": "dir = -1 AND b.rn >= fresh AND NOT coalesce(b.rn >= least(mit, brk), false)",
    "mitigated_bull": "dir = 1 AND b.rn >= mit AND NOT coalesce(b.rn >= brk, false)", "mitigated_bear": "dir = -1 AND b.rn >= mit AND NOT coalesce(b.rn >= brk, false)",
    "breaker_bull": "dir = -1 AND b.rn >= brk", "breaker_bear": "dir = 1 AND b.rn >= brk",
}
OB_LEVELS = ", ".join(
    f"{q(f'arg_max({v}, born) FILTER ({when})')} AS {side}_{name}"
    for side, when in (("bull", "dir = 1 AND b.rn >= fresh AND NOT coalesce(b.rn >= brk, false)"), ("bear", "dir = -1 AND b.rn >= fresh AND NOT coalesce(b.rn >= brk, false)"), ("breaker", "b.rn >= brk"))
    for v, name in (("top", "top"), ("bot", "bottom"), ("far", "gap_far"))
)


@query("order_block_levels", over(f"""{OB_SQL.rsplit("ev AS", 1)[0].rstrip().rstrip(",")},
z6 AS (SELECT z.*, CASE z.dir WHEN 1 THEN g.low ELSE g.high END AS far FROM z5 z JOIN b g ON g.symbol = z.symbol AND g.rn = z.born)
SELECT b.symbol, '1d' AS timeframe, b.rn, b.time, {OB_LEVELS}, {', '.join(f'count(*) FILTER ({when}) AS {name}' for name, when in OB_STATES.items())}
FROM b LEFT JOIN z6 ON z6.symbol = b.symbol GROUP BY ALL""", "brand", True))
def _(spark, d):
    return tidy(K.order_block_levels(bars(spark, d)))


# ---- zones of several timeframes: the same book by a recursion over single steps of a day -----


def _score_sql(weight: str, count: str, wick: str, prominence: str, atr: str) -> str:
    unit = lambda x: f"least(1.0, greatest(0.0, {x}))"
    raw = f"({unit(weight)} * 0.40 + {unit(f'({count} - 1) / 2.0')} * 0.28 + {unit(f'{wick} / ({atr} * 0.6)')} * 0.18 + {unit(f'{prominence} / ({atr} * 3)')} * 0.14)"
    return f"least(10.0, greatest(0.0, {raw} * 10 + 0.9 * ({count} - 1)))"


SLOTS_SQL = "(VALUES (0, 30::BIGINT, 'M30', 0.55), (1, 60, 'H1', 0.78), (2, 120, 'H2', 0.78), (3, 240, 'H4', 1.0)) t(slot, mins, label, weight)"
ZONE_BOOK = f""", {atr_ctes(14)},
ar AS MATERIALIZED (SELECT b.*, epoch_us(time) // 86400000000 AS day, coalesce(nullif(CASE WHEN rn >= 14 THEN a ELSE plain END, 0), 1e-6) AS atr, lead(time) OVER (PARTITION BY symbol ORDER BY rn) AS nx FROM aw JOIN ta USING (symbol, rn) JOIN b USING (symbol, rn)),
cg AS (SELECT ar.symbol AS base, slot, any_value(mins) AS mins, any_value(label) AS label, any_value(weight) AS weight, epoch_us(time) // (mins * 60000000) AS bucket,
  arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, max(time) AS lt, nullif(arg_max(coalesce(nx, TIMESTAMP '1970-01-01'), time), TIMESTAMP '1970-01-01') AS nx FROM ar, {SLOTS_SQL} GROUP BY ar.symbol, slot, epoch_us(time) // (mins * 60000000)),
ch AS (SELECT *, CASE WHEN epoch_us(lt) + 900000000 >= (bucket + 1) * mins * 60000000 THEN lt ELSE nx END AS confirm FROM cg),
ci AS MATERIALIZED (SELECT *, base || '|' || slot AS symbol, bucket AS time, row_number() OVER w AS rn, count(*) OVER (PARTITION BY base, slot) AS n, avg((high + low) / 2) OVER (PARTITION BY base, slot ORDER BY bucket ROWS 9 PRECEDING) AS mean
  FROM ch WHERE confirm IS NOT NULL WINDOW w AS (PARTITION BY base, slot ORDER BY bucket)),
{pivots_sql('ci', 5, 5, False, True, name='zp')},
ze AS (SELECT p.base AS symbol, k.confirm AS time, p.slot, p.rn AS crn, zp.kind = 'high' AS res, zp.price AS level, p.label, p.weight,
  greatest(CASE zp.kind WHEN 'high' THEN p.high - greatest(p.open, p.close) ELSE least(p.open, p.close) - p.low END, 0) AS wick,
  greatest(CASE zp.kind WHEN 'high' THEN p.high - k.mean ELSE k.mean - p.low END, 0) AS prom
  FROM zp JOIN ci p USING (symbol, rn) JOIN ci k ON k.symbol = p.symbol AND k.rn = p.rn + 5),
zf AS (SELECT ze.*, ar.rn, ar.day, ar.atr FROM ze JOIN ar ON ar.symbol = ze.symbol AND ar.time = ze.time),
zg AS (SELECT * FROM zf QUALIFY coalesce(abs(level - lag(level) OVER (PARTITION BY symbol, day, slot, res ORDER BY rn, crn)) > 1e-9, true)),
zd AS MATERIALIZED (SELECT symbol, day, list({{'rn': rn, 'atr': atr, 'z': {{'res': res, 'level': level, 'top': level + greatest(atr * 0.28, 1e-6) / 2, 'bottom': level - greatest(atr * 0.28, 1e-6) / 2,
  'score': {_score_sql('weight', '1', 'wick', 'prom', 'atr')}, 'fr': [label], 'w': weight::DOUBLE, 'ws': wick, 'wn': CASE WHEN wick > 0 THEN 1 ELSE 0 END, 'pr': prom, 'st': rn}}}} ORDER BY rn, slot, crn, res DESC) AS ev FROM zg GROUP BY ALL),
zk AS (SELECT symbol, day, 0 AS k, 'shown' AS phase, list_filter([ev[1].z], lambda z: false) AS zs FROM zd
  UNION ALL SELECT s.symbol, s.day, CASE WHEN phase IN ('add', 'shown') THEN k + 1 ELSE k END,
    CASE WHEN phase IN ('add', 'shown') THEN CASE WHEN k + 1 < len(ev) AND ev[k + 2].rn = ev[k + 1].rn THEN 'add' ELSE 'unite' END
         WHEN phase = 'unite' THEN CASE WHEN p IS NULL THEN 'cut' ELSE 'unite' END ELSE CASE WHEN len(zs) > 14 THEN 'cut' ELSE 'shown' END END,
    CASE WHEN phase IN ('add', 'shown') THEN list_append(zs, ev[k + 1].z)
         WHEN phase = 'unite' AND p IS NOT NULL THEN list_concat(list_concat(zs[1 : p.i - 1], [{{'res': u.res, 'level': u.level, 'top': u.level + greatest(at_ * 0.28, 1e-6) / 2, 'bottom': u.level - greatest(at_ * 0.28, 1e-6) / 2,
             'score': {_score_sql('u.w', 'len(u.fr)', '(u.ws / greatest(u.wn, 1))', 'u.pr', 'at_')}, 'fr': u.fr, 'w': u.w, 'ws': u.ws, 'wn': u.wn, 'pr': u.pr, 'st': u.st}}]), list_concat(zs[p.i + 1 : p.j - 1], zs[p.j + 1 :]))
         WHEN phase = 'cut' AND len(zs) > 14 THEN list_concat(zs[1 : list_position(list_transform(zs, lambda z: z.score), list_min(list_transform(zs, lambda z: z.score))) - 1], zs[list_position(list_transform(zs, lambda z: z.score), list_min(list_transform(zs, lambda z: z.score))) + 1 :])
         ELSE zs END
  FROM zk s JOIN zd USING (symbol, day), LATERAL (SELECT ev[greatest(k, 1)].atr AS at_),
  LATERAL (SELECT CASE WHEN phase = 'unite' THEN list_filter(flatten(list_transform(range(1, len(zs) + 1), lambda i: list_transform(range(i + 1, len(zs) + 1), lambda j: {{'i': i, 'j': j}}))),
    lambda x: zs[x.i].res = zs[x.j].res AND zs[x.i].bottom <= zs[x.j].top + at_ * 0.35 AND zs[x.j].bottom <= zs[x.i].top + at_ * 0.35)[1] END AS p),
  LATERAL (SELECT {{'res': zs[p.i].res, 'level': (zs[p.i].level * greatest(zs[p.i].wn, 1) + zs[p.j].level * greatest(zs[p.j].wn, 1)) / (greatest(zs[p.i].wn, 1) + greatest(zs[p.j].wn, 1)),
    'fr': list_concat(zs[p.i].fr, list_filter(zs[p.j].fr, lambda f: NOT list_contains(zs[p.i].fr, f))), 'w': greatest(zs[p.i].w, zs[p.j].w), 'ws': zs[p.i].ws + zs[p.j].ws, 'wn': zs[p.i].wn + zs[p.j].wn, 'pr': greatest(zs[p.i].pr, zs[p.j].pr), 'st': zs[p.i].st}} AS u)
  WHERE NOT (phase = 'shown' AND k = len(ev))),
zv AS MATERIALIZED (SELECT symbol, day, ev[k].rn AS rn, zs FROM zk JOIN zd USING (symbol, day) WHERE phase = 'shown' AND k > 0),
zy AS (SELECT symbol, day, dense_rank() OVER (PARTITION BY symbol ORDER BY day) AS sn FROM (SELECT DISTINCT symbol, day FROM ar)),
zl AS (SELECT symbol, day, sn, arg_max(zs, rn) AS zs FROM zv JOIN zy USING (symbol, day) GROUP BY ALL),
zb AS (SELECT ar.symbol, ar.rn, ar.n, ar.time, ar.close, ar.atr, coalesce(o2.zs, []) AS z2, coalesce(o1.zs, []) AS z1, coalesce(v.zs, []) AS z0 FROM ar JOIN zy USING (symbol, day)
  LEFT JOIN zl o2 ON o2.symbol = ar.symbol AND o2.sn = zy.sn - 2 LEFT JOIN zl o1 ON o1.symbol = ar.symbol AND o1.sn = zy.sn - 1 ASOF LEFT JOIN zv v ON v.symbol = ar.symbol AND v.day = ar.day AND ar.rn >= v.rn),
za AS MATERIALIZED (SELECT symbol, rn, n, time, close, atr, list_concat(list_concat(z2, z1), z0) AS zs FROM zb),
zu AS MATERIALIZED (SELECT symbol, rn, n, time, close, atr, unnest(zs) AS z, generate_subscripts(zs, 1) - 1 AS place FROM za)"""


@query("mtf_sr_zones", over(f"""{ZONE_BOOK},
nr AS (SELECT symbol, rn, first(z.level ORDER BY CASE WHEN z.level >= close THEN z.level - close ELSE (close - z.level) * 2 END, place) FILTER (z.res) AS r,
  first(z.level ORDER BY CASE WHEN z.level <= close THEN close - z.level ELSE (z.level - close) * 2 END, place) FILTER (NOT z.res) AS s,
  first(z.level ORDER BY abs(z.level - close), place) FILTER (len(z.fr) > 1) AS f FROM zu GROUP BY ALL)
SELECT symbol, '15m' AS timeframe, rn, time, 'bar' AS kind, NULL::BOOLEAN AS res, NULL::DOUBLE AS level, NULL::DOUBLE AS top, NULL::DOUBLE AS bottom, NULL::DOUBLE AS score, NULL AS frames, NULL::BIGINT AS confluence, NULL::DOUBLE AS wick_avg,
  NULL::DOUBLE AS prominence, NULL::BIGINT AS start_rn, {q('s')} AS support, {q('r')} AS resistance, {q('f')} AS confluence_level, NULL::BIGINT AS place FROM za LEFT JOIN nr USING (symbol, rn)
UNION ALL SELECT symbol, '15m', rn, time, 'zone', z.res, {q('z.level')}, {q('z.top')}, {q('z.bottom')}, {q('z.score')}, array_to_string(z.fr, ','), len(z.fr), {q('z.ws / greatest(z.wn, 1)')}, {q('z.pr')}, z.st, NULL, NULL, NULL, place FROM zu WHERE rn = n""", "quarter", True))
def _(spark, d):
    return tidy(Y.mtf_sr(bars(spark, d, "quarter"), 900))


_FRAMES = ("M30", "H1", "H2", "H4")
_SIDES = ", ".join(f"count(*) FILTER ({'z.res' if side == 'res' else 'NOT z.res'} AND list_contains(z.fr, '{f}')) AS {f}_{side}" for f in _FRAMES for side in ("res", "sup"))
_BIAS = ", ".join(f"CASE WHEN {f}_res + {f}_sup = 0 THEN '—' WHEN {f}_res > {f}_sup THEN 'RES' WHEN {f}_sup > {f}_res THEN 'SUP' ELSE 'BAL' END AS {f}_bias" for f in _FRAMES)


@query("agg_zone_dashboard", over(f"""{ZONE_BOOK},
g AS (SELECT symbol, count(*) AS zones, count(*) FILTER (len(z.fr) > 1) AS confluences, avg(z.score) AS sc, first(z.level ORDER BY z.score DESC, place) AS sl, max(z.score) AS ss, any_value(atr) AS at_, any_value(close) AS lc,
  coalesce(first(z.level ORDER BY z.level - close, place) FILTER (z.res AND z.level >= close), first(z.level ORDER BY place) FILTER (z.res)) AS nr,
  coalesce(first(z.level ORDER BY close - z.level, place) FILTER (NOT z.res AND z.level <= close), first(z.level ORDER BY place) FILTER (NOT z.res)) AS ns, {_SIDES} FROM zu WHERE rn = n GROUP BY symbol)
SELECT symbol, '15m' AS timeframe, zones, confluences, {q('sc')} AS avg_score, {q('nr')} AS nearest_res, {q('ns')} AS nearest_sup, {q('at_')} AS atr, {q('lc')} AS last_close, {', '.join(f'{f}_{s}' for f in _FRAMES for s in ('res', 'sup'))},
  {q('(nr - ns) / greatest(at_, 1e-9)')} AS room_atr, CASE WHEN lc - ns < nr - lc THEN 'Near SUP' WHEN nr IS NOT NULL AND ns IS NOT NULL THEN 'Near RES' END AS price_position, {q('sl')} AS strongest_level, {q('ss')} AS strongest_score, {_BIAS} FROM g""", "quarter", True))
def _(spark, d):
    b = bars(spark, d, "quarter")
    return tidy(Y.zone_dashboard(Y.mtf_sr(b, 900), b))


@query("strength_score", over(f""", x AS (SELECT symbol, time, (rn % 5) * 0.25 AS tf, 1 + rn % 4 AS cc, high - greatest(open, close) AS wk, high - low AS pr, close / 4 AS at_ FROM b),
y AS (SELECT *, (least(1, greatest(0, tf)) * 0.4 + least(1, greatest(0, (cc - 1) / 2.0)) * 0.28 + CASE WHEN at_ > 0 THEN least(1, wk / (at_ * 0.6)) ELSE 0 END * 0.18 + CASE WHEN at_ > 0 THEN least(1, pr / (at_ * 3)) ELSE 0 END * 0.14) AS raw FROM x),
z AS (SELECT symbol, time, least(10, greatest(0, raw * 10 + 0.9 * (cc - 1))) AS s FROM y)
SELECT symbol, time, {q('s')} AS score, CASE WHEN s >= 8 THEN 'ELITE' WHEN s >= 6.5 THEN 'STRONG' WHEN s >= 5 THEN 'MODERATE' WHEN s >= 3.5 THEN 'WEAK' ELSE 'FORMING' END AS tier FROM z"""))
def _(spark, d):
    b = bars(spark, d).withColumns({"tf": (c("rn") % 5) * 0.25, "cc": 1 + c("rn") % 4, "wk": c("high") - F.greatest("open", "close"), "pr": c("high") - c("low"), "at": c("close") / 4})
    df = b.withColumn("score", Y.strength_score("tf", "cc", "wk", "pr", "at")).withColumn("tier", Y.tier("score"))
    return tidy(df, "symbol", "time", "score", "tier")


# ---- sinks -----------------------------------------------------------------------------------


@query("sink_bar_csv", over(f"""SELECT symbol, time, strftime(time, '%Y-%m-%dT%H:%M:%S.000Z') || ',' || concat_ws(',', round(open, 2)::VARCHAR, round(close, 2)::VARCHAR) || ',' || CASE WHEN rn >= 20 THEN printf('%.4f', avg(close) {rows(20)} + 1e-7) ELSE '' END AS line FROM b""", "hourly"))
def _(spark, d):
    df = I.sma(bars(spark, d, "hourly"), 20).withColumn("sma", c("sma") + 1e-7)
    full = W.csv_table(df, ["sma"])
    parts = F.split("line", ",")
    # The oracle checks the stamp, two prices and the indicator cell of each line.
    short = F.concat_ws(",", parts[0], parts[1], parts[4], parts[6])
    return tidy(full.withColumn("line", short), "symbol", "time", "line")


@query("sink_chart_payload", over(f""", t AS (SELECT *, CASE WHEN rn >= 20 THEN floor(avg(close) {rows(20)} * 10000 + 0.5) / 10000 END AS sma FROM b)
SELECT symbol, count(*) AS bars, {q('sum(close)')} AS close_sum, {q('sum(sma)')} AS sma_sum FROM t WHERE rn > n - 200 GROUP BY symbol""", "hourly"))
def _(spark, d):
    df = I.sma(bars(spark, d, "hourly"), 20)
    out = W.chart_payload(df.withColumn("sma", W.round_series("sma", 4)), ["sma"])
    got = out.withColumn("p", F.from_json("payload", "candles array<struct<time:string,close:double>>, series struct<sma:array<double>>"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    return got.select("symbol", F.size("p.candles").cast("long").alias("bars"), r(total(F.transform("p.candles", lambda x: x["close"]))).alias("close_sum"), r(total(c("p.series.sma"))).alias("sma_sum"))


@query("sink_round_series", over("SELECT symbol, time, CASE WHEN rn % 10 = 0 THEN NULL ELSE floor((close - open) * 100 + 0.5) / 100 + 0.0 END AS v FROM b", "hourly"))
def _(spark, d):
    raw = F.when(c("rn") % 20 == 0, F.lit(float("nan"))).when(c("rn") % 10 == 0, F.lit(float("inf"))).otherwise(c("close") - c("open"))
    return bars(spark, d, "hourly").withColumn("x", raw).select("symbol", c("time").cast("timestamp_ntz").alias("time"), W.round_series("x", 2).alias("v"))


# ---- series upkeep ---------------------------------------------------------------------------


@query("merge_tail", over(f"SELECT symbol, time, {q('CASE WHEN rn % 3 = 0 THEN close * 2 ELSE close END')} AS close FROM b", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly").select("symbol", "timeframe", "time", "rn", "close")
    fresh = b.filter(c("rn") % 3 == 0).withColumns({"close": c("close") * 2, "seq": F.lit(2)})
    return tidy(M.merge_tail(b.withColumn("seq", F.lit(1)), fresh), "symbol", "time", "close")


@query("older_than", over(f"SELECT symbol, time, {q('close')} AS close FROM b WHERE time < TIMESTAMP '2024-01-15 12:00:00'", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly").select("symbol", "timeframe", "time", "close")
    twice = b.withColumn("seq", F.lit(1)).unionByName(b.withColumns({"close": c("close") + 1, "seq": F.lit(2)}))
    return tidy(M.older_than(twice, F.lit("2024-01-15 12:00:00").cast("timestamp")), "symbol", "time", "close")


@query("anti_missing_provider", over("SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-x' END AS symbol, p_size % 2 = 0 AS present FROM part WHERE p_size % 2 = 1 OR p_brand IN (SELECT symbol FROM b)"))
def _(spark, d):
    wanted = table(spark, d, "part").select(F.concat("p_brand", F.when(c("p_size") % 2 == 0, "").otherwise("-x")).alias("symbol")).distinct()
    have, gone = M.split_by_available(wanted, bars(spark, d))
    return have.withColumn("present", F.lit(True)).unionByName(gone.withColumn("present", F.lit(False)))


# ---- marks -----------------------------------------------------------------------------------


def marks_of(spark, d):
    """Levels, zones and two-point paths at every eleventh bar, scattered around the price."""
    b = bars(spark, d, "hourly").filter(c("rn") % 11 == 0)
    k = c("rn") % 4
    mult = 0.2 + (c("rn") % 7) * 0.7
    later = lambda hours: F.timestamp_micros(F.unix_micros("time") + hours * 3600000000)
    path = F.array(F.struct(F.when(c("rn") % 3 == 0, F.lit("2023-12-31 00:00:00").cast("timestamp")).otherwise(c("time")).alias("time"), c("close").alias("price")), F.struct(later(100).alias("time"), (c("close") * mult).alias("price")))
    return b.select(
        "symbol", F.lit("local").alias("source"), F.when(c("rn") % 2 == 0, "1h").otherwise("4h").alias("timeframe"), c("rn").alias("mark"),
        F.when(k == 0, "level").when(k == 1, "zone").when(k == 2, "path").otherwise("note").alias("type"), F.when(c("rn") % 5 == 0, "target").otherwise("support").alias("role"),
        (c("high") * mult).alias("price"), (c("low") * mult).alias("low"), (c("low") * mult + c("rn") % 3 * 0.01).alias("high"),
        F.when(c("rn") % 9 == 0, later(500)).alias("available_at"), F.when(k == 2, path).alias("points"),
        F.when(c("rn") % 6 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(c("rn") % 8 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("swing"))).alias("sources"), (c("rn") % 3).alias("request_id"),
    )


MK = """mk AS (SELECT symbol, CASE WHEN rn % 2 = 0 THEN '1h' ELSE '4h' END AS tf, rn AS mark, ['level', 'zone', 'path', 'note'][rn % 4 + 1] AS type, CASE WHEN rn % 5 = 0 THEN 'target' ELSE 'support' END AS role, high * (0.2 + (rn % 7) * 0.7) AS price, low * (0.2 + (rn % 7) * 0.7) AS zl,
  low * (0.2 + (rn % 7) * 0.7) + rn % 3 * 0.01 AS zh, CASE WHEN rn % 9 = 0 THEN time + INTERVAL 500 HOUR END AS avail, CASE WHEN rn % 3 = 0 THEN TIMESTAMP '2023-12-31' ELSE time END AS t1, close AS p1, time + INTERVAL 100 HOUR AS t2, close * (0.2 + (rn % 7) * 0.7) AS p2 FROM b WHERE rn % 11 = 0),
ws AS (SELECT symbol, min(low) AS lo, max(high) AS hi, min(time) AS first, max(time) AS last, max(close) FILTER (rn = n) AS lastc, max(time) + to_microseconds(greatest(((epoch_us(max(time)) - epoch_us(min(time))) * 0.1)::BIGINT, (epoch_us(max(time)) - epoch_us(max(time) FILTER (rn = n - 1))) * 150)) AS lim FROM b GROUP BY symbol)"""


@query("join_marks_bars", over(f""", {MK}, m1 AS (SELECT *, tf <> '1h' AS x FROM mk JOIN ws USING (symbol)),
m2 AS (SELECT *, CASE WHEN role = 'target' THEN lo * 0.5 WHEN x THEN lo - greatest((hi - lo) * 0.3, (hi + lo) * 0.015) ELSE lo * 0.7 END AS f, CASE WHEN role = 'target' THEN hi * 2 WHEN x THEN hi + greatest((hi - lo) * 0.3, (hi + lo) * 0.015) ELSE hi * 1.3 END AS c,
  CASE WHEN x AND t1 < first THEN p1 + (p2 - p1) * (epoch_us(first) - epoch_us(t1)) / (epoch_us(t2) - epoch_us(t1)) ELSE p1 END AS q1 FROM m1)
SELECT symbol, mark, type, CASE type WHEN 'level' THEN price BETWEEN f AND c WHEN 'zone' THEN (avail IS NULL OR avail <= last) AND zl BETWEEN f AND c AND zh BETWEEN f AND c
  WHEN 'path' THEN q1 BETWEEN f AND c AND p2 BETWEEN f AND c AND (x OR (t1 >= first AND t2 <= lim)) ELSE true END AS kept FROM m2""", "hourly"))
def _(spark, d):
    return M.join_marks(marks_of(spark, d), bars(spark, d, "hourly")).select(c("symbol"), "mark", "type", "kept").join(
        bars(spark, d, "hourly").select(c("symbol").alias("s")).distinct(), F.upper("s") == c("symbol")
    ).select(c("s").alias("symbol"), "mark", "type", "kept")


@query("path_clip", over(f""", {MK}, x AS (SELECT * FROM mk JOIN ws USING (symbol) WHERE type = 'path' AND t2 > t1)
SELECT symbol, mark, CASE WHEN t1 < first THEN first ELSE t1 END AS start_time, {q('CASE WHEN t1 < first THEN p1 + (p2 - p1) * (epoch_us(first) - epoch_us(t1)) / (epoch_us(t2) - epoch_us(t1)) ELSE p1 END', 3)} AS start_price, {q('p2', 3)} AS end_price FROM x""", "hourly"))
def _(spark, d):
    df = marks_of(spark, d).filter(c("type") == "path").join(M.window_stats(bars(spark, d, "hourly")).select("symbol", "first"), "symbol")
    df = df.withColumn("p", M.clip_path(c("points"), c("first")))
    return df.select("symbol", "mark", c("p")[0]["time"].cast("timestamp_ntz").alias("start_time"), r(c("p")[0]["price"], 3).alias("start_price"), r(c("p")[1]["price"], 3).alias("end_price"))


@query("marks_combine", over(f""", {MK}, cur AS (SELECT symbol, mark, type = 'zone' AND avail IS NOT NULL AS cand FROM mk), nw AS (SELECT symbol, mark + 100000 AS mark FROM mk WHERE type = 'zone' AND symbol <> 'view')
SELECT symbol, mark FROM cur WHERE symbol NOT IN (SELECT symbol FROM nw) OR NOT cand UNION ALL SELECT * FROM nw""", "hourly"))
def _(spark, d):
    cur = marks_of(spark, d)
    new = cur.filter((c("type") == "zone") & (c("symbol") != "view")).withColumn("mark", c("mark") + 100000)
    return M.combine_marks(cur, new, True).select("symbol", "mark")


@query("annotation_gate", over(f""", {MK}, g AS (SELECT *, CASE WHEN role = 'target' THEN lo * 0.5 ELSE lo * 0.7 END AS f, CASE WHEN role = 'target' THEN hi * 2 ELSE hi * 1.3 END AS c FROM mk JOIN ws USING (symbol) WHERE tf = '1h')
SELECT symbol, mark, concat_ws(',', CASE WHEN (type = 'level' AND NOT price BETWEEN f AND c) OR (type = 'zone' AND NOT (zl BETWEEN f AND c AND zh BETWEEN f AND c)) OR (type = 'path' AND NOT (p1 BETWEEN f AND c AND p2 BETWEEN f AND c)) THEN 'price_out_of_band' END,
  CASE WHEN type = 'zone' AND NOT zl < zh THEN 'zone_order' END, CASE WHEN type = 'zone' AND zh - zl < lastc * 0.0005 AND zl < zh THEN 'zone_too_thin' END, CASE WHEN type = 'path' AND (t1 < first OR t2 > lim) THEN 'point_time' END,
  CASE WHEN mark % 6 = 0 THEN 'confidence' END, CASE WHEN mark % 8 = 0 THEN 'no_sources' END) AS violations FROM g""", "hourly"))
def _(spark, d):
    m = marks_of(spark, d).filter(c("timeframe") == "1h")
    return M.annotation_gate(m, bars(spark, d, "hourly")).select("symbol", "mark", F.array_join("violations", ",").alias("violations"))


# ---- alerts ----------------------------------------------------------------------------------

KP_ALERTS = ("hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "gap_up", "gap_down", "three_rising", "three_falling")


@query("alert_events", over(f""", {facts_sql()}, {' , '.join([f"t1 AS (SELECT *, coalesce(close > {lag('close', 4)}, false) AS u, coalesce(close < {lag('close', 4)}, false) AS dn FROM b)", f"t2 AS (SELECT *, max(CASE WHEN NOT u THEN rn END) {P}) AS su, max(CASE WHEN NOT dn THEN rn END) {P}) AS sd FROM t1)", "t3 AS (SELECT symbol, time, rn, n, CASE WHEN u THEN rn - coalesce(su, 0) ELSE 0 END AS up, CASE WHEN dn THEN rn - coalesce(sd, 0) ELSE 0 END AS dc FROM t2)"])},
a AS ({' UNION ALL '.join(f"SELECT symbol, time, rn, n, 'kp.{x}' AS code FROM kp WHERE coalesce({KP.ALL_PATTERNS[x]}, false)" for x in KP_ALERTS)} {' '.join(f"UNION ALL SELECT symbol, time, rn, n, 'td.{s}{k}' FROM t3 WHERE {x} = {k}" for k in (9, 13) for s, x in (('up', 'up'), ('dn', 'dc')))})
SELECT symbol, time, strftime(time, '%Y-%m-%dT%H:%M:%S.000Z') || '|' || code AS alert_id FROM a WHERE rn < n"""))
def _(spark, d):
    df = I.td_count(bars(spark, d))
    rules = {x: KP.ALL_PATTERNS[x] for x in KP_ALERTS}
    df = KP.candle_patterns(df, rules)
    td = {f"td.{s}{k}": c(f"td_{s}") == k for k in (9, 13) for s in ("up", "dn")}
    return tidy(M.alert_rows(df, {**{f"kp.{x}": c(x) for x in KP_ALERTS}, **td}, last_closed_only=False), "symbol", "time", "alert_id")


# ---- user functions --------------------------------------------------------------------------


def range_share(candles):
    """Where the close lies in the range of the last ten bars; undefined on a flat range."""
    top, low = candles["high"].rolling(10).max(), candles["low"].rolling(10).min()
    return (candles["close"] - low) / (top - low)


@query("udf_custom_indicator", over(f", x AS (SELECT *, max(high) {rows(10)} AS t, min(low) {rows(10)} AS l FROM b) SELECT symbol, time, {q('CASE WHEN rn >= 10 THEN (close - l) / nullif(t - l, 0) END', 6)} AS range_share FROM x", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly").select("symbol", "timeframe", "time", "open", "high", "low", "close", "volume", "rn", "n")
    return tidy(U.custom_indicator(b, "range_share", range_share, 10), "symbol", "time", "range_share", digits=6)


def three_rises(bar, position):
    """Buy after three rising closes, leave after a fall."""
    if position is None:
        return "enter_long" if bar["rises"] >= 3 else "hold"
    return "exit_long" if bar["rises"] == 0 else "hold"


RISES = f"""x AS (SELECT *, CASE WHEN close > {lag('close')} THEN 1 ELSE 0 END AS up FROM b), y AS (SELECT *, up + up * {lag('up')} + up * {lag('up')} * {lag('up', 2)} AS rises FROM x),
oi AS MATERIALIZED (SELECT symbol, rn, n, time, close, coalesce(rises, 0) AS rises FROM y)"""


@query("udf_strategy", over(f", {RISES}, {account_sql(chr(67) + 'ASE WHEN a.side IS NULL THEN CASE WHEN i.rises >= 3 THEN ' + repr('enter_long') + ' ELSE ' + repr('hold') + ' END WHEN i.rises = 0 THEN ' + repr('exit_long') + ' ELSE ' + repr('hold') + ' END')} SELECT symbol, entry_rn, exit_rn, side, {q('entry_price')} AS entry_price, {q('exit_price')} AS exit_price, return_pct FROM tr", "hourly", True))
def _(spark, d):
    f = frame(bars(spark, d, "hourly"), 4)
    f = f.add(_up=F.coalesce((c("close") > f.lag("close")).cast("int"), F.lit(0)))
    f = f.add(rises=F.coalesce(c("_up") + c("_up") * f.lag("_up") + c("_up") * f.lag("_up") * f.lag("_up", 2), F.lit(0)))
    return tidy(U.custom_strategy(f.rows(), three_rises, ("rises",)), "symbol", "entry_rn", "exit_rn", "side", "entry_price", "exit_price", "return_pct")
