"""Folds over bars: trend followers, signals, grid, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, q, query, tidy
from barloom.catalog.indicators import adx_ctes, atr_ctes, lag, prior, rows, rsi_ctes, rsi_value, trunc_sql
from barloom.operators import backtest as B
from barloom.operators import signals as S

c = F.col


def st_ctes(p: int, factor: float, tag="st") -> str:
    """Recursive SuperTrend over ``b``; the CTE holds one row per bar from row p on."""
    base = f"""{atr_ctes(p, tag)},
{tag}i AS MATERIALIZED (SELECT symbol, rn, high, low, close, {lag('close')} AS pc, (high + low) / 2 - {factor} * a AS lo, (high + low) / 2 + {factor} * a AS hi FROM b JOIN aw{tag} USING (symbol, rn)),"""
    return base + f"""
{tag} AS (SELECT symbol, rn, lo AS lower, hi AS upper, true AS down FROM {tag}i WHERE rn = {p}
  UNION ALL SELECT i.symbol, i.rn, nl, nu, CASE WHEN s.down THEN NOT (close > nu) ELSE close < nl END
  FROM {tag} s JOIN {tag}i i ON i.symbol = s.symbol AND i.rn = s.rn + 1,
  LATERAL (SELECT CASE WHEN lo > s.lower OR pc < s.lower THEN lo ELSE s.lower END AS nl, CASE WHEN hi < s.upper OR pc > s.upper THEN hi ELSE s.upper END AS nu))"""


@query("supertrend", over(f""", {st_ctes(60, 4.0)}
SELECT b.symbol, b.time, {q('CASE WHEN down THEN upper ELSE lower END')} AS st_value, CASE WHEN down IS NULL THEN NULL WHEN down THEN 'bearish' ELSE 'bullish' END AS st_direction
FROM b LEFT JOIN st USING (symbol, rn)""", "hourly", True))
def _(spark, d):
    return tidy(S.supertrend(bars(spark, d, "hourly")), "symbol", "time", "st_value", "st_direction")


@query("evasive_supertrend", over(f""", {atr_ctes(10)},
ei AS MATERIALIZED (SELECT symbol, rn, close, a, (high + low) / 2 - 3 * a AS lo, (high + low) / 2 + 3 * a AS hi FROM b JOIN aw USING (symbol, rn) WHERE rn >= 10),
z AS (SELECT symbol, 9::BIGINT AS rn, NULL::DOUBLE AS band, 1 AS trend, NULL::BOOLEAN AS noisy, false AS flip FROM ei WHERE rn = 10
  UNION ALL SELECT i.symbol, i.rn, CASE WHEN fl THEN CASE WHEN z.trend = 1 THEN hi ELSE lo END ELSE mv END, CASE WHEN fl THEN -z.trend ELSE z.trend END, ny, fl
  FROM z JOIN ei i ON i.symbol = z.symbol AND i.rn = z.rn + 1,
  LATERAL (SELECT coalesce(z.band, CASE WHEN z.trend = 1 THEN lo ELSE hi END) AS held),
  LATERAL (SELECT abs(close - held) < a AS ny),
  LATERAL (SELECT CASE WHEN ny THEN held - z.trend * a * 0.5 WHEN z.trend = 1 THEN greatest(lo, held) ELSE least(hi, held) END AS mv),
  LATERAL (SELECT CASE WHEN z.trend = 1 THEN close < mv ELSE close > mv END AS fl))
SELECT b.symbol, b.time, {q('z.band')} AS band, CASE WHEN z.band IS NOT NULL THEN z.trend END::BIGINT AS trend, z.noisy, CASE WHEN z.flip THEN CASE WHEN z.trend = 1 THEN 'bull' ELSE 'bear' END END AS signal
FROM b LEFT JOIN z USING (symbol, rn)""", "hourly", True))
def _(spark, d):
    return tidy(S.evasive_supertrend(bars(spark, d, "hourly")), "symbol", "time", "band", "trend", "noisy", "signal")


# ---- entry signals ---------------------------------------------------------------------------

SIG = f"""{st_ctes(60, 4.0)}, {atr_ctes(14, '14')}, {rsi_ctes(14)}, {adx_ctes()},
wm AS (SELECT symbol, rn, list(close) {rows(60)} AS held FROM b),
sg AS MATERIALIZED (SELECT b.symbol, b.rn, b.n, b.time, high, low, close, {lag('close')} AS pc,
  CASE WHEN down THEN 'short' WHEN NOT down THEN 'long' END AS side, CASE WHEN down THEN upper ELSE lower END AS band, {lag('down')} AS pdown, down,
  CASE WHEN b.rn >= 14 THEN aw14.a END AS atr, CASE WHEN b.rn >= 60 THEN list_sum(list_transform(range(1, 61), lambda k: k * held[k])) / 1830 END AS wma,
  {rsi_value(14, 'rs')} AS rsi, CASE WHEN b.rn >= 28 THEN da.a END AS adx
  FROM b LEFT JOIN st USING (symbol, rn) JOIN aw14 USING (symbol, rn) JOIN rs USING (symbol, rn) JOIN da USING (symbol, rn) JOIN wm USING (symbol, rn)),
sc AS (SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sn, coalesce(pdown <> down, false) AS flip,
  CASE WHEN side = 'long' THEN low <= band + 0.5 * atr AND close > pc AND close > band ELSE high >= band - 0.5 * atr AND close < pc AND close < band END AS pull FROM sg),
sd AS MATERIALIZED (SELECT *, rn > 1 AND rn < n AND side IS NOT NULL AND atr IS NOT NULL AND wma IS NOT NULL AND rsi IS NOT NULL AND adx IS NOT NULL AND (flip OR pull) AND adx >= 20
   AND CASE WHEN side = 'long' THEN close > wma AND rsi < 70 ELSE close < wma AND rsi > 30 END AND sn * (close - (band - sn * 0.25 * atr)) > 0 AS can,
   band - sn * 0.25 * atr AS stop, sn * (close - (band - sn * 0.25 * atr)) AS risk FROM sc),
mm AS (SELECT symbol, 1::BIGINT AS rn, NULL::BIGINT AS sig, ''::VARCHAR AS ss, 0.0::DOUBLE AS sstop, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 'none' AS status, false AS t1, (-99)::BIGINT AS ll, (-99)::BIGINT AS ls, false AS fresh, NULL::BIGINT AS shown
   FROM sd WHERE rn = 1
  UNION ALL
  SELECT i.symbol, i.rn, CASE WHEN take THEN i.rn WHEN fin THEN NULL ELSE m.sig END, CASE WHEN take THEN i.side ELSE m.ss END,
    CASE WHEN take THEN i.stop ELSE m.sstop END, CASE WHEN take THEN i.close + i.sn * 1.5 * i.risk ELSE m.s1 END, CASE WHEN take THEN i.close + i.sn * 3 * i.risk ELSE m.s2 END,
    CASE WHEN take THEN 'open' ELSE st END, CASE WHEN take THEN false ELSE m.t1 OR (m.sig IS NOT NULL AND st <> 'stopped' AND tt) END,
    CASE WHEN take AND i.side = 'long' THEN i.rn ELSE m.ll END, CASE WHEN take AND i.side = 'short' THEN i.rn ELSE m.ls END, take, CASE WHEN take THEN i.rn ELSE m.shown END
  FROM mm m JOIN sd i ON i.symbol = m.symbol AND i.rn = m.rn + 1 AND i.rn < i.n,
  LATERAL (SELECT CASE WHEN m.ss = 'long' THEN i.high >= m.s1 ELSE i.low <= m.s1 END AS tt),
  LATERAL (SELECT CASE WHEN m.sig IS NULL THEN m.status WHEN m.ss = 'long' AND i.low <= m.sstop OR m.ss = 'short' AND i.high >= m.sstop THEN 'stopped'
     WHEN m.ss = 'long' AND i.high >= m.s2 OR m.ss = 'short' AND i.low <= m.s2 THEN 'target2' WHEN tt THEN 'target1' ELSE m.status END AS st),
  LATERAL (SELECT m.sig IS NOT NULL AND st IN ('stopped', 'target2') AS fin),
  LATERAL (SELECT (m.sig IS NULL OR fin) AND coalesce(i.can, false) AND i.rn - CASE WHEN i.side = 'long' THEN m.ll ELSE m.ls END >= 6 AS take)),
-- a signal's last state is the row before the next signal; its own rows are those showing it
es AS (SELECT symbol, shown, arg_max(status, rn) FILTER (TRUE) AS last_status FROM mm WHERE shown IS NOT NULL GROUP BY symbol, shown),
en AS (SELECT mm.*, lead(fresh) OVER (PARTITION BY symbol ORDER BY rn) AS nf FROM mm),
-- the closing bar of a signal may also open the next one, so its outcome is taken from the input bars
fx AS (SELECT f.symbol, f.rn, f.ss, f.sstop, f.s1, f.s2, min(i.rn) FILTER (CASE WHEN ss = 'long' THEN i.low <= sstop ELSE i.high >= sstop END) AS stop_rn,
  min(i.rn) FILTER (CASE WHEN ss = 'long' THEN i.high >= s2 ELSE i.low <= s2 END) AS t2_rn, min(i.rn) FILTER (CASE WHEN ss = 'long' THEN i.high >= s1 ELSE i.low <= s1 END) AS t1_rn
  FROM mm f LEFT JOIN sd i ON i.symbol = f.symbol AND i.rn > f.rn AND i.rn < i.n WHERE f.fresh GROUP BY ALL),
ey AS (SELECT *, CASE WHEN stop_rn IS NOT NULL AND (t2_rn IS NULL OR stop_rn <= t2_rn) THEN 'stopped' WHEN t2_rn IS NOT NULL THEN 'target2' WHEN t1_rn IS NOT NULL THEN 'target1' ELSE 'open' END AS status,
  t1_rn IS NOT NULL AND (stop_rn IS NULL OR t1_rn < stop_rn) AND (t2_rn IS NULL OR t1_rn <= t2_rn) AS hit_t1 FROM fx),
ez AS MATERIALIZED (SELECT ey.symbol, ey.rn, sd.time, ss AS side, CASE WHEN flip THEN 'flip' ELSE 'pullback' END AS kind, close AS entry, sstop AS stop, s1 AS target1, s2 AS target2, ey.status, hit_t1,
  CASE ey.status WHEN 'stopped' THEN stop_rn WHEN 'target2' THEN t2_rn END AS closed_rn FROM ey JOIN sd USING (symbol, rn))"""
SIGNAL_COLS = ("symbol", "rn", "time", "side", "kind", "entry", "stop", "target1", "target2")


@query("entry_signals", over(f", {SIG} SELECT symbol, rn, time, side, kind, {q('entry')} AS entry, {q('stop')} AS stop, {q('target1')} AS target1, {q('target2')} AS target2 FROM ez", "brand", True))
def _(spark, d):
    return tidy(S.entry_signals(bars(spark, d)), *SIGNAL_COLS)


@query("signal_status", over(f", {SIG} SELECT symbol, rn, side, status, hit_t1, closed_rn FROM ez", "brand", True))
def _(spark, d):
    return tidy(S.entry_signals(bars(spark, d)), "symbol", "rn", "side", "status", "hit_t1", "closed_rn")


RECORD = """count(*) FILTER (status IN ('stopped', 'target2')) AS finished, count(*) FILTER (status IN ('stopped', 'target2') AND hit_t1) AS hit_t1,
  count(*) FILTER (status = 'target2') AS hit_t2, count(*) FILTER (status = 'stopped') AS stopped, count(*) FILTER (status NOT IN ('stopped', 'target2')) AS active"""


@query("agg_signal_record", over(f", {SIG} SELECT symbol, {RECORD} FROM ez GROUP BY symbol", "brand", True))
def _(spark, d):
    return tidy(S.signal_record(S.entry_signals(bars(spark, d))).drop("timeframe"))


@query("signal_rows", over(f""", {SIG},
lk AS (SELECT b.symbol, b.time, b.rn, b.n, max(ez.rn) AS srn FROM b LEFT JOIN ez ON ez.symbol = b.symbol AND ez.rn <= b.rn GROUP BY ALL),
sx AS (SELECT lk.*, f.ss, f.stop_rn, f.t1_rn, f.t2_rn FROM lk LEFT JOIN ey f ON f.symbol = lk.symbol AND f.rn = lk.srn)
SELECT symbol, time, rn < n AS confirmed, srn AS signal_rn, ss AS side, CASE WHEN srn IS NULL THEN NULL
  WHEN stop_rn <= rn AND (t2_rn IS NULL OR t2_rn >= stop_rn) THEN 'stopped' WHEN t2_rn <= rn THEN 'target2' WHEN t1_rn <= rn THEN 'target1' ELSE 'open' END AS as_of_status FROM sx""", "brand", True))
def _(spark, d):
    return tidy(S.signal_rows(bars(spark, d)), "symbol", "time", "confirmed", "signal_rn", "side", "as_of_status")


@query("signal_report", over(f""", {SIG},
ns AS (SELECT symbol, arg_max(row(rn, side, kind, status), rn) AS g FROM ez GROUP BY symbol), rc AS (SELECT symbol, {RECORD} FROM ez GROUP BY symbol),
la AS (SELECT sd.*, g, finished, hit_t1, hit_t2, stopped, active, sd.rn - g[1] AS ago FROM sd LEFT JOIN ns USING (symbol) LEFT JOIN rc USING (symbol) WHERE sd.rn = sd.n - 1)
SELECT symbol, time, side AS trend, concat_ws(',', CASE WHEN side = 'long' AND close <= wma OR side = 'short' AND close >= wma THEN 'wma60' END,
  CASE WHEN side IS NOT NULL AND adx < 20 THEN 'adx' END, CASE WHEN side = 'long' AND rsi >= 70 OR side = 'short' AND rsi <= 30 THEN 'rsi' END, CASE WHEN active > 0 THEN 'active' END) AS blockers,
  CASE WHEN ago <= 48 THEN g[2] END AS side, CASE WHEN ago <= 48 THEN g[3] END AS kind, CASE WHEN ago <= 48 THEN g[4] END AS status, CASE WHEN ago <= 48 THEN ago END AS bars_ago,
  coalesce(finished, 0) AS finished, coalesce(hit_t1, 0) AS hit_t1, coalesce(hit_t2, 0) AS hit_t2, coalesce(stopped, 0) AS stopped, coalesce(active, 0) AS active FROM la""", "brand", True))
def _(spark, d):
    return tidy(S.signal_report(bars(spark, d)), "symbol", "time", "trend", "blockers", "side", "kind", "status", "bars_ago",
                "finished", "hit_t1", "hit_t2", "stopped", "active")


# ---- RSI grid --------------------------------------------------------------------------------


def grid_side_sql(name: str, low: float, high: float, short: bool) -> str:
    depth = f"greatest(x - {high}, 0)" if short else f"greatest({low} - x, 0)"
    back = f"x <= {low}" if short else f"x >= {high}"
    losing = "close > p1" if short else "close < p1"
    return f"""
{name} AS (SELECT symbol, rn, CASE WHEN x IS NULL THEN 0.0 ELSE {depth} END AS cum, NULL::BIGINT AS prn, NULL::DOUBLE AS pos, false AS pe, false AS px, NULL::VARCHAR AS sig, NULL::DOUBLE AS fill, NULL::DOUBLE AS out_, NULL::BIGINT AS orn, NULL::DOUBLE AS op FROM gi WHERE rn = 1
  UNION ALL SELECT i.symbol, i.rn, cm, pr1, p1, en, ex, CASE WHEN en THEN 'entry' WHEN ex THEN 'exit' END, CASE WHEN g.pe AND p0 IS NULL THEN open END,
    CASE WHEN g.px AND g.pos IS NOT NULL THEN open END, g.prn, g.pos
  FROM {name} g JOIN gi i ON i.symbol = g.symbol AND i.rn = g.rn + 1,
  LATERAL (SELECT CASE WHEN g.px THEN NULL ELSE g.pos END AS p0),
  LATERAL (SELECT CASE WHEN g.pe AND p0 IS NULL THEN open ELSE p0 END AS p1, CASE WHEN g.pe AND p0 IS NULL THEN i.rn WHEN p0 IS NULL THEN NULL ELSE g.prn END AS pr1),
  LATERAL (SELECT CASE WHEN x IS NULL THEN 0.0 ELSE {depth} END AS dp), LATERAL (SELECT CASE WHEN dp > 0 THEN g.cum + dp ELSE 0.0 END AS cm),
  LATERAL (SELECT p1 IS NULL AND dp > 0 AND cm > 10 AS en, p1 IS NOT NULL AND coalesce({back}, false) AND NOT ({losing}) AS ex))"""


GRID_SQL = f"""{rsi_ctes(7)}, gi AS MATERIALIZED (SELECT b.symbol, b.rn, b.n, b.time, b.open, b.close, {rsi_value(7, 'rs')} AS x FROM b JOIN rs USING (symbol, rn)),
{grid_side_sql('gl', 30.0, 60.0, False)}, {grid_side_sql('gs', 40.0, 70.0, True)},
gt AS (SELECT 'long' AS side, symbol, orn AS entry_rn, op AS entry, rn AS exit_rn, out_ AS exit FROM gl WHERE out_ IS NOT NULL
  UNION ALL SELECT 'short', symbol, orn, op, rn, out_ FROM gs WHERE out_ IS NOT NULL
  UNION ALL SELECT 'long', symbol, prn, pos, NULL, NULL FROM gl JOIN (SELECT DISTINCT symbol, n FROM b) USING (symbol) WHERE rn = n AND pos IS NOT NULL
  UNION ALL SELECT 'short', symbol, prn, pos, NULL, NULL FROM gs JOIN (SELECT DISTINCT symbol, n FROM b) USING (symbol) WHERE rn = n AND pos IS NOT NULL),
gp AS (SELECT *, CASE WHEN side = 'short' THEN entry - exit ELSE exit - entry END * 100 / entry AS pct FROM gt),
gr AS (SELECT symbol, side, count(exit) AS closed, count(*) FILTER (pct > 0) AS wins, floor(avg(pct) * 100 + 0.5) / 100 AS avg_pct FROM gp GROUP BY symbol, side)"""


@query("rsi_grid", over(f", {GRID_SQL} SELECT symbol, side, entry_rn, {q('entry')} AS entry, exit_rn, {q('exit')} AS exit FROM gt", "hourly", True))
def _(spark, d):
    return tidy(S.rsi_grid(bars(spark, d, "hourly")), "symbol", "side", "entry_rn", "entry", "exit_rn", "exit")


def side_cols(t: str, side: str) -> str:
    cum = f"-{t}.cum" if side == "short" else f"{t}.cum"
    return f"""{q(cum)} AS {side}_cum, {t}.sig AS {side}_signal, {q(t + '.fill')} AS {side}_entry, {q(t + '.out_')} AS {side}_exit, {t}.pos IS NOT NULL AS {side}_in_pos, {q(t + '.pos')} AS {side}_pos_entry"""


@query("rsi_grid_rows", over(f", {GRID_SQL} SELECT gi.symbol, gi.time, {q('gi.x')} AS rsi, {side_cols('gl', 'long')}, {side_cols('gs', 'short')} FROM gi JOIN gl USING (symbol, rn) JOIN gs USING (symbol, rn)", "hourly", True))
def _(spark, d):
    side = ("cum", "signal", "entry", "exit", "in_pos", "pos_entry")
    return tidy(S.rsi_grid_rows(bars(spark, d, "hourly")), "symbol", "time", "rsi", *[f"{s}_{x}" for s in ("long", "short") for x in side])


@query("agg_grid_record", over(f", {GRID_SQL} SELECT * FROM gr", "hourly", True))
def _(spark, d):
    return S.grid_record(S.rsi_grid(bars(spark, d, "hourly"))).drop("timeframe")


@query("rsi_grid_report", over(f""", {GRID_SQL},
e AS (SELECT 'long' AS side, gi.symbol, gi.n, gi.time, gi.close, gi.x, gl.cum, gl.sig, gl.pos, gl.prn FROM gi JOIN gl USING (symbol, rn) WHERE rn = n
  UNION ALL SELECT 'short', gi.symbol, gi.n, gi.time, gi.close, gi.x, gs.cum, gs.sig, gs.pos, gs.prn FROM gi JOIN gs USING (symbol, rn) WHERE rn = n)
SELECT symbol, side, time, floor(x * 100 + 0.5) / 100 AS rsi, floor(cum * 100 + 0.5) / 100 AS cum, sig AS pending, floor(pos * 100 + 0.5) / 100 AS entry, n - prn AS bars_held,
  floor(CASE WHEN side = 'short' THEN pos - close ELSE close - pos END * 100 / pos * 100 + 0.5) / 100 AS pnl_pct, coalesce(closed, 0) AS closed, coalesce(wins, 0) AS wins, avg_pct
FROM e LEFT JOIN gr USING (symbol, side)""", "hourly", True))
def _(spark, d):
    return tidy(S.rsi_grid_report(bars(spark, d, "hourly")).drop("timeframe"))


# ---- backtests -------------------------------------------------------------------------------


def account_sql(orders: str) -> str:
    """Recursive account over ``oi`` (symbol, rn, n, time, close, ...) with lateral order expression ``act``."""
    return f"""
ac AS (SELECT symbol, 0::BIGINT AS rn, 10000.0::DOUBLE AS eq, NULL::VARCHAR AS side, 0.0::DOUBLE AS entry, 0::BIGINT AS since, 0.0::DOUBLE AS sh, false AS shut, NULL::VARCHAR AS oside, 0.0::DOUBLE AS oentry, 0::BIGINT AS osince, 0.0::DOUBLE AS oprice, 0.0::DOUBLE AS net FROM oi WHERE rn = 1
  UNION ALL SELECT i.symbol, i.rn, eq1, CASE WHEN go THEN ns WHEN sx THEN NULL ELSE a.side END, CASE WHEN go THEN np ELSE a.entry END, CASE WHEN go THEN i.rn ELSE a.since END,
    CASE WHEN go THEN (eq1 - eq1 * 0.0005) / np ELSE a.sh END, sx, a.side, a.entry, a.since, xp, nt
  FROM ac a JOIN oi i ON i.symbol = a.symbol AND i.rn = a.rn + 1,
  LATERAL (SELECT {orders} AS act),
  LATERAL (SELECT coalesce(a.side IS NOT NULL AND (i.rn = i.n OR CASE WHEN a.side = 'long' THEN act IN ('exit_long', 'enter_short') ELSE act IN ('exit_short', 'enter_long') END), false) AS sx,
    CASE WHEN a.side = 'long' THEN close * (1 - 0.0002) ELSE close * (1 + 0.0002) END AS xp, CASE WHEN a.side = 'long' THEN 1 ELSE -1 END AS sn),
  LATERAL (SELECT a.sh * sn * (xp - a.entry) - a.sh * xp * 0.0005 AS nt), LATERAL (SELECT CASE WHEN sx THEN a.eq + nt ELSE a.eq END AS eq1),
  LATERAL (SELECT (a.side IS NULL OR sx) AND i.rn < i.n AND act IN ('enter_long', 'enter_short') AS go, substr(act, 7) AS ns),
  LATERAL (SELECT CASE WHEN ns = 'long' THEN close * (1 + 0.0002) ELSE close * (1 - 0.0002) END AS np)),
tr AS (SELECT ac.symbol, osince AS entry_rn, ac.rn AS exit_rn, oi.time AS exit_time, oside AS side, floor(oentry * 10000 + 0.5) / 10000 AS entry_price, floor(oprice * 10000 + 0.5) / 10000 AS exit_price,
  floor(net * 100 + 0.5) / 100 AS pnl, floor((CASE WHEN oside = 'long' THEN 1 ELSE -1 END * (oprice / oentry - 1) - 0.0005) * 10000 + 0.5) / 100 AS return_pct, ac.rn - osince AS holding_bars
  FROM ac JOIN oi USING (symbol, rn) WHERE shut),
eqc AS (SELECT ac.symbol, oi.time, ac.rn, oi.n, eq + CASE WHEN side IS NULL THEN 0 ELSE sh * (close - entry) * CASE WHEN side = 'long' THEN 1 ELSE -1 END END AS equity FROM ac JOIN oi USING (symbol, rn))"""


TE = f"x AS (SELECT *, list(close) {rows(25)} AS h12, list(close) {rows(53)} AS h26 FROM b), y AS (SELECT symbol, rn, n, time, close, {trunc_sql(12)} AS f, {trunc_sql(26)} AS s FROM x)"
EMA_BT = f"""{TE}, oi AS MATERIALIZED (SELECT *, CASE WHEN rn > 27 AND {lag('f')} <= {lag('s')} AND f > s THEN 'enter_long' WHEN rn > 27 AND {lag('f')} >= {lag('s')} AND f < s THEN 'enter_short' ELSE 'hold' END AS ord FROM y),
{account_sql('i.ord')}"""
DON_ACT = """CASE WHEN i.eh IS NULL THEN 'hold'
  WHEN a.side IS NULL THEN CASE WHEN close > eh THEN 'enter_long' WHEN close < el THEN 'enter_short' ELSE 'hold' END
  WHEN a.side = 'long' AND close < xl THEN CASE WHEN close < el THEN 'enter_short' ELSE 'exit_long' END
  WHEN a.side = 'short' AND close > xh THEN CASE WHEN close > eh THEN 'enter_long' ELSE 'exit_short' END ELSE 'hold' END"""
DON_BT = f"""oi AS MATERIALIZED (SELECT symbol, rn, n, time, close, CASE WHEN rn > 20 THEN max(high) {prior(20)} END AS eh, CASE WHEN rn > 20 THEN min(low) {prior(20)} END AS el,
  CASE WHEN rn > 20 THEN max(high) {prior(10)} END AS xh, CASE WHEN rn > 20 THEN min(low) {prior(10)} END AS xl FROM b), {account_sql(DON_ACT)}"""
TRADE_COLS = ("symbol", "entry_rn", "exit_rn", "exit_time", "side", "entry_price", "exit_price", "return_pct", "holding_bars")
TRADE_SQL = f"SELECT symbol, entry_rn, exit_rn, exit_time, side, {q('entry_price')} AS entry_price, {q('exit_price')} AS exit_price, return_pct, holding_bars FROM tr"


@query("bt_dual_ema", over(f", {EMA_BT} {TRADE_SQL}", "hourly", True))
def _(spark, d):
    return tidy(B.bt_dual_ema(bars(spark, d, "hourly")), *TRADE_COLS)


@query("bt_donchian", over(f", {DON_BT} {TRADE_SQL}", "hourly", True))
def _(spark, d):
    return tidy(B.bt_donchian(bars(spark, d, "hourly")), *TRADE_COLS)


@query("bt_trades", over(f", {DON_BT} SELECT symbol, time, {q('equity', 2)} AS equity FROM eqc", "hourly", True))
def _(spark, d):
    return tidy(B.bt_donchian(bars(spark, d, "hourly"), emit="equity"), "symbol", "time", "equity", digits=2)


@query("bt_drawdown", over(f""", {DON_BT}, pk AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY rn)) AS peak FROM eqc)
SELECT symbol, floor(max((peak - equity) / peak) * 10000 + 0.5) / 100 AS max_drawdown_pct, floor(arg_max(equity, rn) * 100 + 0.5) / 100 AS final_equity FROM pk GROUP BY symbol""", "hourly", True))
def _(spark, d):
    b = bars(spark, d, "hourly")
    equity = B.bt_donchian(b, emit="equity")
    return B.drawdown(equity).drop("timeframe")


@query("agg_trade_stats", over(f""", {DON_BT}, g AS (SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gp, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS gl,
  avg(return_pct / 100) AS m, coalesce(stddev_samp(return_pct / 100), 0) AS sd FROM tr GROUP BY symbol)
SELECT symbol, trades, wins, losses, floor(wins / trades * 10000 + 0.5) / 100 AS win_rate_pct, floor(CASE WHEN gl > 0 THEN gp / gl WHEN gp > 0 THEN 99.99 ELSE 0 END * 100 + 0.5) / 100 AS profit_factor,
  floor(CASE WHEN sd > 0 THEN m / sd * sqrt(least(trades, 252)) ELSE 0 END * 100 + 0.5) / 100 AS sharpe FROM g""", "hourly", True))
def _(spark, d):
    return B.trade_stats(B.bt_donchian(bars(spark, d, "hourly"))).drop("timeframe")
