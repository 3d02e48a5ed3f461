"""Per-bar indicators as queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, q, query, r, scan_sql, tidy
from barloom.functions.exprs import price_source
from barloom.operators import indicators as I
from barloom.plans.blocks import runs

KEY = ("symbol", "time")
P = "OVER (PARTITION BY symbol ORDER BY rn"


def rows(k: int) -> str:
    return f"{P} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def prior(k: int) -> str:
    return f"{P} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) {P})"


@query("proj_price_source", over(f"""
SELECT symbol, time, {q('close')} AS close, {q('open')} AS open, {q('high')} AS high, {q('low')} AS low,
  {q('(high+low)/2')} AS hl2, {q('(high+low+close)/3')} AS hlc3, {q('(open+high+low+close)/4')} AS ohlc4,
  {q('(high+low+2*close)/4')} AS hlcc4 FROM b"""))
def _(spark, d):
    names = ("close", "open", "high", "low", "hl2", "hlc3", "ohlc4", "hlcc4")
    return bars(spark, d).select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), *[r(price_source(x)).alias(x) for x in names])


@query("sma", over(f"SELECT symbol, time, CASE WHEN rn >= 20 THEN {q(f'avg(close) {rows(20)}')} END AS sma FROM b"))
def _(spark, d):
    return tidy(I.sma(bars(spark, d), 20), *KEY, "sma")


@query("wma", over(f""",
x AS (SELECT *, list(close) {rows(60)} AS held FROM b)
SELECT symbol, time, CASE WHEN rn >= 60 THEN {q("list_sum(list_transform(range(1, 61), lambda k: k * held[k])) / 1830")} END AS wma FROM x"""))
def _(spark, d):
    return tidy(I.wma(bars(spark, d), 60), *KEY, "wma")


def ema_sql(w: int, value="close", src="b", out="eb", first=1) -> str:
    """CTE ``out`` with column b{w}: the recurrence input of an EMA."""
    k = 2 / (w + 1)
    return (f"CASE WHEN rn < {first + w - 1} THEN 0.0 WHEN rn = {first + w - 1} THEN avg({value}) {rows(w)} "
            f"ELSE {value} * {k!r} END")


@query("ema", over(f""",
e AS (SELECT *, {ema_sql(20)} AS eb FROM b), {scan_sql('y', 'e', {'v': (1 - 2 / 21, 'eb')})}
SELECT symbol, time, CASE WHEN rn >= 20 THEN {q('v')} END AS ema FROM y JOIN b USING (symbol, rn)""", "hourly", True))
def _(spark, d):
    return tidy(I.ema(bars(spark, d, "hourly"), 20), *KEY, "ema")


@query("macd", over(f""",
e AS (SELECT *, {ema_sql(12)} AS fb, {ema_sql(26)} AS sb FROM b),
{scan_sql('y', 'e', {'f': (1 - 2 / 13, 'fb'), 's': (1 - 2 / 27, 'sb')})},
l AS (SELECT symbol, rn, CASE WHEN rn >= 26 THEN f - s END AS line FROM y),
g AS (SELECT *, {ema_sql(9, 'line', first=26)} AS gb FROM l),
{scan_sql('z', 'g', {'v': (1 - 2 / 10, 'gb')})}
SELECT b.symbol, b.time, {q('line')} AS macd, CASE WHEN rn >= 34 THEN {q('v')} END AS macd_signal,
  CASE WHEN rn >= 34 THEN {q('line - v')} END AS macd_hist
FROM l JOIN z USING (symbol, rn) JOIN b USING (symbol, rn)""", "hourly", True))
def _(spark, d):
    return tidy(I.macd(bars(spark, d, "hourly")), *KEY, "macd", "macd_signal", "macd_hist")


def rsi_ctes(p: int, tag: str = "") -> str:
    """CTEs ending in ``rs{tag}`` with the averages g and l of the RSI."""
    wild = lambda v: (f"CASE WHEN rn < {p + 1} THEN 0.0 WHEN rn = {p + 1} THEN avg({v}) {rows(p)} ELSE {v} / {p} END")
    return f"""
m{tag} AS (SELECT symbol, rn, greatest(coalesce(close - {lag('close')}, 0), 0) AS up, greatest(coalesce({lag('close')} - close, 0), 0) AS dn FROM b),
w{tag} AS (SELECT symbol, rn, {wild('up')} AS gb, {wild('dn')} AS lb FROM m{tag}),
{scan_sql('rs' + tag, 'w' + tag, {'g': (1 - 1 / p, 'gb'), 'l': (1 - 1 / p, 'lb')})}"""


def rsi_value(p: int, t: str, pine: bool = False) -> str:
    flat = f"WHEN {t}.g = 0 THEN 0.0" if pine else ""
    return f"(CASE WHEN {t}.rn <= {p} THEN NULL WHEN {t}.l = 0 THEN 100.0 {flat} ELSE 100 - 100 / (1 + {t}.g / {t}.l) END)"


@query("rsi", over(f", {rsi_ctes(14)} SELECT b.symbol, b.time, {q(rsi_value(14, 'rs'))} AS rsi FROM rs JOIN b USING (symbol, rn)", "hourly", True))
def _(spark, d):
    return tidy(I.rsi(bars(spark, d, "hourly")), *KEY, "rsi")


@query("pine_rsi", over(f", {rsi_ctes(14)} SELECT b.symbol, b.time, {q(rsi_value(14, 'rs', True))} AS pine_rsi FROM rs JOIN b USING (symbol, rn)", "hourly", True))
def _(spark, d):
    return tidy(I.pine_rsi(bars(spark, d, "hourly")), *KEY, "pine_rsi")


CUTLER = f"""
d AS (SELECT *, close - {lag('close')} AS chg FROM b),
cu AS (SELECT *, sum(greatest(chg, 0)) {rows(14)} AS gain, sum(greatest(-chg, 0)) {rows(14)} AS loss FROM d)"""
CUTLER_VALUE = "(CASE WHEN rn < 15 THEN NULL WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END)"


@query("cutler_rsi", over(f", {CUTLER} SELECT symbol, time, {q(CUTLER_VALUE)} AS cutler_rsi FROM cu"))
def _(spark, d):
    return tidy(I.cutler_rsi(bars(spark, d)), *KEY, "cutler_rsi")


STOCH = f"""
s1 AS (SELECT *, max(high) {rows(14)} AS hi, min(low) {rows(14)} AS lo FROM b),
s2 AS (SELECT *, CASE WHEN rn < 14 THEN NULL WHEN hi = lo THEN 50.0 ELSE (close - lo) / (hi - lo) * 100 END AS raw FROM s1),
s3 AS (SELECT *, CASE WHEN rn >= 16 THEN avg(raw) {rows(3)} END AS k FROM s2),
s4 AS (SELECT *, CASE WHEN rn >= 18 THEN avg(k) {rows(3)} END AS dd FROM s3)"""


@query("stochastic", over(f", {STOCH} SELECT symbol, time, {q('k')} AS stoch_k, {q('dd')} AS stoch_d FROM s4"))
def _(spark, d):
    return tidy(I.stochastic(bars(spark, d)), *KEY, "stoch_k", "stoch_d")


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
TR_SAFE = f"CASE WHEN rn = 1 THEN high - low ELSE {TR} END"


@query("true_range", over(f"SELECT symbol, time, {q(TR_SAFE)} AS tr FROM b"))
def _(spark, d):
    return tidy(I.true_range(bars(spark, d)), *KEY, "tr")


def wilder_sql(value: str, p: int, first: int = 1) -> str:
    e = first + p - 1
    return f"CASE WHEN rn < {e} THEN 0.0 WHEN rn = {e} THEN avg({value}) {rows(p)} ELSE {value} / {p} END"


def atr_ctes(p: int, tag="") -> str:
    return f"""
t{tag} AS (SELECT symbol, rn, {TR_SAFE} AS tr FROM b),
ta{tag} AS (SELECT *, {wilder_sql('tr', p)} AS ab, avg(tr) {rows(p)} AS plain FROM t{tag}),
{scan_sql('aw' + tag, 'ta' + tag, {'a': (1 - 1 / p, 'ab')})}"""


@query("atr", over(f", {atr_ctes(14)} SELECT symbol, time, CASE WHEN rn >= 14 THEN {q('a')} END AS atr FROM aw JOIN b USING (symbol, rn)", "hourly", True))
def _(spark, d):
    return tidy(I.atr(bars(spark, d, "hourly")), *KEY, "atr")


@query("atr_progressive", over(f", {atr_ctes(14)} SELECT symbol, time, CASE WHEN rn >= 14 THEN {q('a')} ELSE {q('plain')} END AS atr_progressive FROM aw JOIN ta USING (symbol, rn) JOIN b USING (symbol, rn)", "hourly", True))
def _(spark, d):
    return tidy(I.atr_progressive(bars(spark, d, "hourly")), *KEY, "atr_progressive")


@query("atr_simple", over(f", t AS (SELECT *, {TR_SAFE} AS tr FROM b) SELECT symbol, time, CASE WHEN rn >= 14 THEN {q(f'avg(tr) {rows(14)}')} END AS atr_simple FROM t"))
def _(spark, d):
    return tidy(I.atr_simple(bars(spark, d)), *KEY, "atr_simple")


MOVES = f"""
mv AS (SELECT symbol, rn, {TR_SAFE} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS down FROM b),
dm AS (SELECT symbol, rn, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pl, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS mi FROM mv)"""


def adx_ctes(p=14) -> str:
    b = lambda v: f"CASE WHEN rn < {p + 1} THEN 0.0 WHEN rn = {p + 1} THEN sum({v}) {rows(p)} ELSE {v} END"
    e = 2 * p
    return f"""{MOVES},
db AS (SELECT symbol, rn, {b('tr')} AS trb, {b('pl')} AS plb, {b('mi')} AS mib FROM dm),
{scan_sql('ds', 'db', {'trs': (1 - 1 / p, 'trb'), 'pls': (1 - 1 / p, 'plb'), 'mis': (1 - 1 / p, 'mib')})},
dx AS (SELECT symbol, rn, CASE WHEN rn > {p} THEN pls / trs * 100 END AS pdi, CASE WHEN rn > {p} THEN mis / trs * 100 END AS mdi FROM ds),
dy AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0.0 ELSE abs(pdi - mdi) / (pdi + mdi) * 100 END AS x FROM dx),
dz AS (SELECT *, CASE WHEN rn < {e} THEN 0.0 WHEN rn = {e} THEN avg(x) {rows(p)} ELSE x / {p} END AS xb FROM dy),
{scan_sql('da', 'dz', {'a': (1 - 1 / p, 'xb')})}"""


@query("adx", over(f", {adx_ctes()} SELECT b.symbol, b.time, CASE WHEN rn >= 28 THEN {q('a')} END AS adx, {q('pdi')} AS plus_di, {q('mdi')} AS minus_di FROM da JOIN dx USING (symbol, rn) JOIN b USING (symbol, rn)", "hourly", True))
def _(spark, d):
    return tidy(I.adx(bars(spark, d, "hourly")), *KEY, "adx", "plus_di", "minus_di")


def adx_pine_ctes(p=14) -> str:
    w = lambda v: wilder_sql(v, p, 2)
    e = 2 * p
    return f"""{MOVES},
db AS (SELECT symbol, rn, {w('tr')} AS trb, {w('pl')} AS plb, {w('mi')} AS mib FROM dm),
{scan_sql('ds', 'db', {'trs': (1 - 1 / p, 'trb'), 'pls': (1 - 1 / p, 'plb'), 'mis': (1 - 1 / p, 'mib')})},
dx AS (SELECT symbol, rn, CASE WHEN rn > {p} THEN pls / trs * 100 END AS pdi, CASE WHEN rn > {p} THEN mis / trs * 100 END AS mdi FROM ds),
dy AS (SELECT *, abs(pdi - mdi) / (CASE WHEN pdi + mdi = 0 THEN 1 ELSE pdi + mdi END) AS x FROM dx),
dz AS (SELECT *, CASE WHEN rn < {e} THEN 0.0 WHEN rn = {e} THEN avg(x) {rows(p)} ELSE x / {p} END AS xb FROM dy),
{scan_sql('da', 'dz', {'a': (1 - 1 / p, 'xb')})}"""


@query("adx_pine", over(f", {adx_pine_ctes()} SELECT b.symbol, b.time, CASE WHEN rn >= 28 THEN {q('100 * a')} END AS adx_pine FROM da JOIN b USING (symbol, rn)", "hourly", True))
def _(spark, d):
    return tidy(I.adx_pine(bars(spark, d, "hourly")), *KEY, "adx_pine")


MFI = f"""
f1 AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
f2 AS (SELECT *, {lag('tp')} AS tp1 FROM f1),
f3 AS (SELECT *, sum(CASE WHEN tp > tp1 THEN tp * volume ELSE 0 END) {rows(14)} AS fp, sum(CASE WHEN tp < tp1 THEN tp * volume ELSE 0 END) {rows(14)} AS fn FROM f2)"""
MFI_VALUE = "(CASE WHEN rn < 15 THEN NULL WHEN fn = 0 THEN 100.0 WHEN fp = 0 THEN 0.0 ELSE 100 - 100 / (1 + fp / fn) END)"


@query("mfi", over(f", {MFI} SELECT symbol, time, {q(MFI_VALUE)} AS mfi FROM f3"))
def _(spark, d):
    return tidy(I.mfi(bars(spark, d)), *KEY, "mfi")


BOLL = f"bo AS (SELECT *, avg(close) {rows(20)} AS mid, stddev_pop(close) {rows(20)} AS sd FROM b)"


@query("bollinger", over(f""", {BOLL} SELECT symbol, time, CASE WHEN rn >= 20 THEN {q('mid + 2 * sd', 3)} END AS bb_upper,
CASE WHEN rn >= 20 THEN {q('mid', 3)} END AS bb_middle, CASE WHEN rn >= 20 THEN {q('mid - 2 * sd', 3)} END AS bb_lower FROM bo"""))
def _(spark, d):
    return tidy(I.bollinger(bars(spark, d)), *KEY, "bb_upper", "bb_middle", "bb_lower", digits=3)


@query("donchian", over(f"""SELECT symbol, time, CASE WHEN rn >= 20 THEN {q(f'max(high) {rows(20)}')} END AS dc_upper,
CASE WHEN rn >= 20 THEN {q(f'min(low) {rows(20)}')} END AS dc_lower FROM b"""))
def _(spark, d):
    return tidy(I.donchian(bars(spark, d)), *KEY, "dc_upper", "dc_lower")


KELTNER = f"""
ke AS (SELECT *, {ema_sql(20)} AS eb FROM b), {scan_sql('ky', 'ke', {'v': (1 - 2 / 21, 'eb')})}, {atr_ctes(20, '20')}"""


@query("keltner", over(f""", {KELTNER} SELECT symbol, time, CASE WHEN rn >= 20 THEN {q('v + 1.5 * a')} END AS kc_upper,
CASE WHEN rn >= 20 THEN {q('v')} END AS kc_basis, CASE WHEN rn >= 20 THEN {q('v - 1.5 * a')} END AS kc_lower
FROM ky JOIN aw20 USING (symbol, rn) JOIN b USING (symbol, rn)""", "hourly", True))
def _(spark, d):
    return tidy(I.keltner(bars(spark, d, "hourly")), *KEY, "kc_upper", "kc_basis", "kc_lower")


# The kernel as a table of distances and weights.
NW = f"""
kw AS (SELECT i AS dist, exp(-(i * i) / (2.0 * 16 * 16)) AS w FROM range(0, 51) t(i)),
nwv AS (SELECT a.symbol, a.rn, sum(p.close * w) / sum(w) AS nw FROM b a JOIN kw ON a.rn > 50
        JOIN b p ON p.symbol = a.symbol AND p.rn = a.rn - dist GROUP BY a.symbol, a.rn),
nwr AS (SELECT a.symbol, a.rn, a.nw, sum(abs(p.close - a.nw) * w) / sum(w) AS res FROM nwv a, kw, b p
        WHERE p.symbol = a.symbol AND p.rn = a.rn - dist GROUP BY a.symbol, a.rn, a.nw),
nwf AS (SELECT b.symbol, b.time, b.rn, close, nw, nw + 1.5 * res AS up, nw - 1.5 * res AS lo FROM b LEFT JOIN nwr USING (symbol, rn))"""


@query("nadaraya_watson", over(f""", {NW}
SELECT symbol, time, {q('nw')} AS nw, {q('up')} AS nw_upper, {q('lo')} AS nw_lower,
  coalesce({lag('nw')} < {lag('nw', 2)} AND nw > {lag('nw')}, false) AS turned_bullish,
  coalesce({lag('nw')} > {lag('nw', 2)} AND nw < {lag('nw')}, false) AS turned_bearish,
  coalesce(close > up AND {lag('close')} <= {lag('up')}, false) AS band_cross_up,
  coalesce(close < lo AND {lag('close')} >= {lag('lo')}, false) AS band_cross_dn,
  coalesce(nw > {lag('nw')}, true) AS nw_bullish FROM nwf""", "hourly"))
def _(spark, d):
    return tidy(I.nadaraya_watson(bars(spark, d, "hourly")), *KEY, "nw", "nw_upper", "nw_lower",
                "turned_bullish", "turned_bearish", "band_cross_up", "band_cross_dn", "nw_bullish")


def runs_sql(state: str, source: str) -> str:
    return f"""
ru AS (SELECT symbol, rn, time, {state} AS st FROM {source}),
rv AS (SELECT *, CASE WHEN st IS NOT NULL AND st IS DISTINCT FROM {lag('st')} THEN 1 ELSE 0 END AS fresh FROM ru),
rw AS (SELECT *, sum(fresh) {P}) AS grp FROM rv WHERE st IS NOT NULL)
SELECT symbol, min(rn) AS start, max(rn) AS "end", any_value(st) AS state, min(time) AS start_time, max(time) AS end_time
FROM rw GROUP BY symbol, grp"""


@query("nw_trend_runs", over(f", {NW}, nx AS (SELECT *, CASE WHEN nw IS NOT NULL THEN coalesce(nw > {lag('nw')}, true) END AS bull FROM nwf), {runs_sql('bull', 'nx')}", "hourly"))
def _(spark, d):
    df = I.nadaraya_watson(bars(spark, d, "hourly"))
    state = F.when(F.col("nw").isNotNull(), F.col("nw_bullish"))
    return tidy(runs(df, state), "symbol", "start", "end", "state", "start_time", "end_time")


VB = f"""{BOLL}, {KELTNER}, {adx_pine_ctes()},
v1 AS (SELECT b.symbol, b.time, b.rn, b.close, CASE WHEN rn >= 20 THEN mid + 2 * sd END AS bu, CASE WHEN rn >= 20 THEN mid - 2 * sd END AS bl,
  CASE WHEN rn >= 20 THEN mid END AS basis, CASE WHEN rn >= 20 THEN v + 1.5 * aw20.a END AS ku, CASE WHEN rn >= 20 THEN v - 1.5 * aw20.a END AS kl,
  coalesce(CASE WHEN rn >= 28 THEN 100 * da.a END > 20, false) AS trend
  FROM b JOIN bo USING (symbol, rn) JOIN ky USING (symbol, rn) JOIN aw20 USING (symbol, rn) JOIN da USING (symbol, rn)),
v2 AS (SELECT *, (close - bl) / greatest(bu - bl, 1e-10) AS pos, coalesce(bu < ku AND bl > kl, false) AS sqz FROM v1),
v3 AS (SELECT *, trend AND rn >= 5 AND sum(CASE WHEN pos >= 0.8 THEN 1 ELSE 0 END) {rows(5)} >= 3 AS wu,
  trend AND rn >= 5 AND sum(CASE WHEN pos <= 1 - 0.8 THEN 1 ELSE 0 END) {rows(5)} >= 3 AS wd FROM v2)"""


@query("vb_pro_read", over(f""", {VB}
SELECT symbol, time, {q('pos')} AS vb_pos, wu AS walk_up, wd AS walk_dn, sqz AS squeeze,
  coalesce({lag('sqz')}, false) AND NOT sqz AND coalesce(close > basis, false) AS fire_up,
  coalesce({lag('sqz')}, false) AND NOT sqz AND coalesce(close < basis, false) AS fire_dn,
  coalesce(NOT trend AND {lag('close')} > {lag('bu')} AND close < bu, false) AS mr_short,
  coalesce(NOT trend AND {lag('close')} < {lag('bl')} AND close > bl, false) AS mr_long,
  CASE WHEN wu THEN 1 WHEN wd THEN -1 ELSE 0 END::BIGINT AS vb_state
FROM v3""", "hourly", True))
def _(spark, d):
    return tidy(I.vb_pro_read(bars(spark, d, "hourly")), *KEY, "vb_pos", "walk_up", "walk_dn", "squeeze",
                "fire_up", "fire_dn", "mr_short", "mr_long", "vb_state")


@query("vb_runs", over(f", {VB}, vr AS (SELECT *, CASE WHEN bu IS NOT NULL THEN CASE WHEN wu THEN 1 WHEN wd THEN -1 ELSE 0 END END::BIGINT AS vs FROM v3), {runs_sql('vs', 'vr')}", "hourly", True))
def _(spark, d):
    df = I.vb_pro_read(bars(spark, d, "hourly"))
    state = F.when(F.col("vb_upper").isNotNull(), F.col("vb_state").cast("long"))
    return tidy(runs(df, state), "symbol", "start", "end", "state", "start_time", "end_time")


@query("td_count", over(f""",
t1 AS (SELECT *, coalesce(close > {lag('close', 4)}, false) AS u, coalesce(close < {lag('close', 4)}, false) AS dn FROM b),
t2 AS (SELECT *, max(CASE WHEN NOT u THEN rn END) {P}) AS su, max(CASE WHEN NOT dn THEN rn END) {P}) AS sd FROM t1)
SELECT symbol, time, CASE WHEN u THEN rn - coalesce(su, 0) ELSE 0 END AS td_up, CASE WHEN dn THEN rn - coalesce(sd, 0) ELSE 0 END AS td_dn FROM t2"""))
def _(spark, d):
    return tidy(I.td_count(bars(spark, d)), *KEY, "td_up", "td_dn")


DIFF = f"""{rsi_ctes(6, 'f')}, {rsi_ctes(12, 's')},
d1 AS (SELECT b.symbol, b.time, b.rn, b.n, {rsi_value(6, 'rsf')} AS r6, {rsi_value(12, 'rss')} AS r12 FROM b JOIN rsf USING (symbol, rn) JOIN rss USING (symbol, rn)),
d2 AS (SELECT *, r6 - r12 AS df FROM d1),
d3 AS (SELECT *, {lag('df')} AS pf FROM d2),
d4 AS (SELECT *, CASE WHEN df > 0.05 THEN 'bullish' WHEN df < -0.05 THEN 'bearish' WHEN df IS NOT NULL THEN 'neutral' END AS dominance,
  CASE WHEN df >= 0 THEN df - pf ELSE pf - df END AS pull,
  CASE WHEN df > 0 AND pf <= 0 THEN 'golden' WHEN df < 0 AND pf >= 0 THEN 'death' END AS "cross" FROM d3),
d5 AS (SELECT *, CASE WHEN pull > 0.05 THEN 'expanding' WHEN pull < -0.05 THEN 'contracting' WHEN pull IS NOT NULL THEN 'flat' END AS momentum,
  CASE WHEN "cross" = 'golden' THEN CASE WHEN r6 < 30 THEN '超卖金叉' WHEN r6 > 70 THEN '高位金叉' ELSE '金叉' END
       WHEN "cross" = 'death' THEN CASE WHEN r6 > 70 THEN '超买死叉' WHEN r6 < 30 THEN '低位死叉' ELSE '死叉' END END AS cross_tag FROM d4)"""


@query("rsi_diff", over(f""", {DIFF} SELECT symbol, time, {q('r6')} AS rsi_fast, {q('r12')} AS rsi_slow, dominance, momentum, "cross", cross_tag FROM d5""", "hourly", True))
def _(spark, d):
    return tidy(I.rsi_diff(bars(spark, d, "hourly")), *KEY, "rsi_fast", "rsi_slow", "dominance", "momentum", "cross", "cross_tag")


@query("rsi_diff_report", over(f""", {DIFF},
hit AS (SELECT symbol, arg_max("cross", rn) AS "cross", arg_max(cross_tag, rn) AS cross_tag, max(rn) AS hit_rn
        FROM d5 WHERE "cross" IS NOT NULL AND rn >= greatest(2, n - 48) GROUP BY symbol)
SELECT d5.symbol, floor(r6 * 100 + 0.5) / 100 AS rsi_fast, floor(r12 * 100 + 0.5) / 100 AS rsi_slow, floor(df * 100 + 0.5) / 100 AS rsi_diff,
  dominance, momentum, hit."cross", hit.cross_tag, n - hit_rn AS cross_bars_ago
FROM d5 LEFT JOIN hit USING (symbol) WHERE rn = n""", "hourly", True))
def _(spark, d):
    out = I.rsi_diff_report(bars(spark, d, "hourly"))
    return out.select("symbol", "rsi_fast", "rsi_slow", "rsi_diff", "dominance", "momentum", "cross", "cross_tag", "cross_bars_ago")


@query("rsi_cum_diff", over(f""", {rsi_ctes(7)},
k1 AS (SELECT b.symbol, b.time, b.rn, {rsi_value(7, 'rs')} AS x FROM rs JOIN b USING (symbol, rn)),
k2 AS (SELECT *, sum(CASE WHEN x < 30 THEN 0 ELSE 1 END) {P}) AS ga, sum(CASE WHEN x > 70 THEN 0 ELSE 1 END) {P}) AS gb FROM k1)
SELECT symbol, time,
  {q("sum(CASE WHEN x < 30 THEN 30 - x ELSE 0 END) OVER (PARTITION BY symbol, ga ORDER BY rn)")} AS cum_long,
  {q("sum(CASE WHEN x > 70 THEN x - 70 ELSE 0 END) OVER (PARTITION BY symbol, gb ORDER BY rn)")} AS cum_short FROM k2""", "hourly", True))
def _(spark, d):
    return tidy(I.rsi_cum_diff(bars(spark, d, "hourly")), *KEY, "cum_long", "cum_short")


@query("volume_ratio_tier", over(f""",
v AS (SELECT *, CASE WHEN rn > 4 THEN avg(volume) {prior(4)} END AS m FROM b),
w AS (SELECT *, CASE WHEN m > 0 THEN volume / m END AS ratio FROM v)
SELECT symbol, time, {q('ratio')} AS volume_ratio, CASE WHEN ratio IS NULL THEN '无前值' WHEN ratio < 1 THEN '量比<1' WHEN ratio < 2 THEN '量比1-2'
  WHEN ratio < 3 THEN '量比2-3' ELSE '量比≥3' END AS volume_tier FROM w"""))
def _(spark, d):
    return tidy(I.volume_ratio_tier(bars(spark, d)), *KEY, "volume_ratio", "volume_tier")


@query("volume_spike", over("""
, t AS (SELECT *, n - rn AS age FROM b), m AS (SELECT symbol, list_sort(list(volume)) AS v FROM t WHERE age BETWEEN 1 AND 288 GROUP BY symbol),
m2 AS (SELECT symbol, CASE WHEN len(v) >= 20 THEN v[len(v) // 2 + 1] END AS med FROM m),
k AS (SELECT symbol, time, rn, age, floor(volume / med * 10 + 0.5) / 10 AS ratio FROM t JOIN m2 USING (symbol) WHERE age < 24)
SELECT symbol, max(CASE WHEN age = 0 THEN ratio END) AS last_ratio, max(ratio) AS peak_ratio, arg_max(time, row(ratio, -rn)) AS peak_time FROM k GROUP BY symbol"""))
def _(spark, d):
    return tidy(I.volume_spike(bars(spark, d)), "symbol", "last_ratio", "peak_ratio", "peak_time")


def trunc_sql(p: int) -> str:
    k = 2 / (p + 1)
    # weight of a close `age` bars back in a window of `len` bars, oldest one unscaled
    return (f"list_sum(list_transform(range(1, len(h{p}) + 1), lambda i: h{p}[i] * pow({1 - k!r}, len(h{p}) - i) * "
            f"(CASE WHEN i = 1 THEN 1.0 ELSE {k!r} END)))")


@query("trunc_ema", over(f", x AS (SELECT *, list(close) {rows(25)} AS h12 FROM b) SELECT symbol, time, {q(trunc_sql(12))} AS trunc_ema FROM x"))
def _(spark, d):
    return tidy(I.trunc_ema(bars(spark, d), 12), *KEY, "trunc_ema")


@query("change_pct", over(f"SELECT symbol, time, {q(f'(close - {lag('close')}) / nullif({lag('close')}, 0) * 100')} AS change_pct FROM b"))
def _(spark, d):
    return tidy(I.change_pct(bars(spark, d)), *KEY, "change_pct")
