"""Pivots, structure, trend lines and zones as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS_SQL, bars, floor_sql, over, q, query, tidy
from barloom.catalog.indicators import P, TR_SAFE, lag, prior, rows, rsi_ctes, rsi_value
from barloom.operators import patterns as K
from barloom.operators import resample as R
from barloom.operators import structure as S
from barloom.operators import zones as Z

c = F.col


def ahead(k: int) -> str:
    return f"{P} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"


def pivots_sql(source="b", left=3, right=3, ls=True, rs=True, skip=0, name="pv", extra="") -> str:
    gt = lambda strict: ">" if strict else ">="
    lt = lambda strict: "<" if strict else "<="
    return f"""
{name}0 AS (SELECT *, max(high) {prior(left)} AS lh, max(high) {ahead(right)} AS rh, min(low) {prior(left)} AS ll, min(low) {ahead(right)} AS rl FROM {source}),
{name} AS (SELECT symbol, time, rn, n, 'high' AS kind, high AS price {extra} FROM {name}0 WHERE rn > {left} AND rn + {right} <= n - {skip} AND high {gt(ls)} lh AND high {gt(rs)} rh
  UNION ALL SELECT symbol, time, rn, n, 'low', low {extra} FROM {name}0 WHERE rn > {left} AND rn + {right} <= n - {skip} AND low {lt(ls)} ll AND low {lt(rs)} rl)"""


PICK = f"SELECT symbol, time, rn, kind, {q('price')} AS price FROM pv"


@query("swing_points", over(f", {pivots_sql(skip=1)} {PICK}"))
def _(spark, d):
    return tidy(S.swing_points(bars(spark, d)), "symbol", "time", "rn", "kind", "price")


@query("pivot_pine", over(f""", g AS (SELECT symbol, {floor_sql(14400, 'time')} AS time, max(high) AS high, min(low) AS low FROM b GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM g),
{pivots_sql('h', 3, 3, True, False)} {PICK}""", "hourly"))
def _(spark, d):
    return tidy(S.pivots(K.coarse_bars(bars(spark, d, "hourly"), "240"), 3, 3, True, False), "symbol", "time", "rn", "kind", "price")


@query("pivot_ob", over(f", {pivots_sql('b', 5, 5, True, False)} {PICK}"))
def _(spark, d):
    return tidy(S.pivots(bars(spark, d), 5, 5, True, False), "symbol", "time", "rn", "kind", "price")


@query("pivot_mtf", over(f", {pivots_sql('b', 5, 3, False, True)} {PICK}"))
def _(spark, d):
    return tidy(S.pivots(bars(spark, d), 5, 3, False, True), "symbol", "time", "rn", "kind", "price")


r2 = lambda x: f"(floor(({x}) * 100 + 0.5) / 100)"
SWING = f"""{rsi_ctes(14)}, br AS (SELECT b.*, {rsi_value(14, 'rs')} AS rsi14 FROM b JOIN rs USING (symbol, rn)),
{pivots_sql('br', skip=1, extra=', rsi14')},
sw AS (SELECT symbol, time, rn AS bar, kind, {r2('price')} AS price, {r2('rsi14')} AS rsi FROM pv),
sl0 AS (SELECT *, lag(price) OVER k AS pp, lag(rsi) OVER k AS pr, lag(time) OVER k AS pt FROM sw WINDOW k AS (PARTITION BY symbol, kind ORDER BY bar)),
sl AS (SELECT *, CASE WHEN pp IS NULL THEN NULL WHEN abs((price - pp) / pp) <= 0.0005 THEN 'EQ'
  WHEN price > pp THEN CASE WHEN kind = 'high' THEN 'HH' ELSE 'HL' END ELSE CASE WHEN kind = 'high' THEN 'LH' ELSE 'LL' END END AS label FROM sl0)"""


@query("swing_labels", over(f", {SWING} SELECT symbol, time, bar, kind, price, rsi, label, pt AS prev_time FROM sl", "hourly", True))
def _(spark, d):
    return tidy(S.swing_labels(bars(spark, d, "hourly")), "symbol", "time", "bar", "kind", "price", "rsi", "label", "prev_time")


@query("swing_trend", over(f""", {SWING}, x AS (SELECT symbol, arg_max(label, bar) FILTER (kind = 'high') AS high_label, arg_max(label, bar) FILTER (kind = 'low') AS low_label FROM sl WHERE label IS NOT NULL GROUP BY symbol)
SELECT *, CASE WHEN high_label IS NULL OR low_label IS NULL THEN NULL WHEN high_label = 'HH' AND low_label = 'HL' THEN 'up' WHEN high_label = 'LH' AND low_label = 'LL' THEN 'down' ELSE 'range' END AS trend FROM x""", "hourly", True))
def _(spark, d):
    return S.swing_trend(S.swing_labels(bars(spark, d, "hourly"))).drop("timeframe")


@query("swing_bias", over(f""", {pivots_sql()},
l0 AS (SELECT *, lag(price) OVER k AS pp, row_number() OVER (PARTITION BY symbol, kind ORDER BY rn DESC) AS age FROM pv WINDOW k AS (PARTITION BY symbol, kind ORDER BY rn)),
l1 AS (SELECT *, CASE WHEN kind = 'high' THEN CASE WHEN pp IS NULL THEN 'H' WHEN price > pp THEN 'HH' WHEN price < pp THEN 'LH' ELSE 'EH' END
  ELSE CASE WHEN pp IS NULL THEN 'L' WHEN price > pp THEN 'HL' WHEN price < pp THEN 'LL' ELSE 'EL' END END AS label FROM l0),
g AS (SELECT symbol, max(label) FILTER (age = 1 AND kind = 'high') AS last_high, max(label) FILTER (age = 1 AND kind = 'low') AS last_low,
  coalesce(max(price) FILTER (age = 1 AND kind = 'high'), 0) AS hp, coalesce(max(price) FILTER (age = 1 AND kind = 'low'), 0) AS lp,
  coalesce(max(price) FILTER (age <= 4 AND kind = 'high'), 0) AS top, coalesce(min(price) FILTER (age <= 4 AND kind = 'low'), 'inf'::DOUBLE) AS bottom,
  coalesce(bool_or(age <= 4 AND label = 'LL'), false) AS ll, coalesce(bool_or(age <= 4 AND label = 'HH'), false) AS hh FROM l1 GROUP BY symbol)
SELECT symbol, last_high, last_low, CASE WHEN ll AND hp < top THEN 'down' WHEN hh AND lp > bottom AND NOT ll THEN 'up'
  WHEN last_high = 'HH' AND last_low = 'HL' AND NOT ll THEN 'up' WHEN last_high = 'LH' AND last_low = 'LL' THEN 'down' ELSE 'range' END AS bias FROM g"""))
def _(spark, d):
    return S.swing_bias(bars(spark, d)).drop("timeframe")


@query("structure_break", over(f""", {pivots_sql(skip=1)},
k AS (SELECT symbol, arg_max({r2('price')}, rn) FILTER (kind = 'high') AS hp, max(rn) FILTER (kind = 'high') AS hr,
  arg_max({r2('price')}, rn) FILTER (kind = 'low') AS lp, max(rn) FILTER (kind = 'low') AS lr FROM pv GROUP BY symbol),
g AS (SELECT b.symbol, any_value(hp) AS hp, any_value(lp) AS lp, max(high) FILTER (rn > hr) AS mh, min(low) FILTER (rn > lr) AS ml,
  max(rn) FILTER (high > hp) AS lu, max(rn) FILTER (low < lp) AS ld FROM b JOIN k USING (symbol) GROUP BY b.symbol),
s AS (SELECT *, CASE WHEN mh > hp AND (NOT coalesce(ml < lp, false) OR lu > coalesce(ld, 0)) THEN 'up' WHEN ml < lp THEN 'down' END AS broken FROM g)
SELECT symbol, hp AS high_price, lp AS low_price, broken, CASE WHEN broken = 'up' THEN {r2('mh')} WHEN broken = 'down' THEN {r2('ml')} END AS reach FROM s"""))
def _(spark, d):
    return S.structure_break(bars(spark, d)).drop("timeframe")


@query("rsi_divergence", over(f""", {SWING},
h AS (SELECT symbol, arg_max(row(price, rsi, pp, pr), bar) FILTER (kind = 'high') AS h, arg_max(row(price, rsi, pp, pr), bar) FILTER (kind = 'low') AS l FROM sl GROUP BY symbol),
h2 AS (SELECT symbol, h[1] AS hp, h[2] AS hr, h[3] AS hpp, h[4] AS hpr, l[1] AS lp, l[2] AS lr, l[3] AS lpp, l[4] AS lpr FROM h)
SELECT symbol, coalesce(lp < lpp AND lr > lpr, false) AS bottom, coalesce(hp > hpp AND hr < hpr, false) AS top,
  coalesce(low < lp AND rsi14 > lr, false) AS potential_bottom, coalesce(high > hp AND rsi14 < hr, false) AS potential_top
FROM br LEFT JOIN h2 USING (symbol) WHERE br.rn = br.n""", "hourly", True))
def _(spark, d):
    return S.rsi_divergence(bars(spark, d, "hourly")).drop("timeframe")


TREND_SQL = f"""{pivots_sql(skip=1)},
tr AS (SELECT *, {TR_SAFE} AS tr FROM b),
tl AS (SELECT *, list_sort(list(tr) {rows(14)}) AS near FROM tr),
sz AS MATERIALIZED (SELECT *, least(close * 0.0015, near[len(near) // 2 + 1] * 0.25) AS slack FROM tl),
pk AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY rn DESC) AS age FROM pv),
nd AS MATERIALIZED (SELECT pk.symbol, pk.kind, pk.rn, pk.n, pk.price, pk.time, slack FROM pk JOIN sz USING (symbol, rn) WHERE age <= 16 AND pk.price > 0),
pr AS MATERIALIZED (SELECT a.symbol, a.kind, a.n, a.rn AS ar, b.rn AS br, a.price AS ap, b.price AS bp, a.time AS at_, b.time AS bt, b.rn - a.rn AS gap, (b.price - a.price) / (b.rn - a.rn) AS slope
  FROM nd a JOIN nd b ON a.symbol = b.symbol AND a.kind = b.kind AND b.rn - a.rn >= 4
  WHERE abs(b.price - a.price) / a.price >= 0.001 AND CASE WHEN a.kind = 'high' THEN b.price < a.price ELSE b.price > a.price END),
bl AS (SELECT pr.*, z.rn, z.close, slack, ap + slope * (z.rn - ar) AS line, CASE WHEN kind = 'high' THEN z.high ELSE z.low END AS edge
  FROM pr JOIN sz z ON z.symbol = pr.symbol AND z.rn > ar AND z.rn < z.n WHERE ap + slope * (pr.n - ar) > 0),
bf AS (SELECT *, CASE WHEN kind = 'high' THEN edge > line + slack ELSE edge < line - slack END AS ebeyond,
  CASE WHEN kind = 'high' THEN close > line + slack ELSE close < line - slack END AS cbeyond,
  CASE WHEN kind = 'high' THEN line - edge ELSE edge - line END > 2 * slack AS dep FROM bl),
fx AS MATERIALIZED (SELECT symbol, kind, ar, br, any_value(n) AS n, any_value(ap) AS ap, any_value(bp) AS bp, any_value(at_) AS at_, any_value(bt) AS bt, any_value(gap) AS gap, any_value(slope) AS slope,
  count(*) FILTER (rn > br AND cbeyond) AS closes, min(rn) FILTER (rn > br AND cbeyond) AS broke, list(rn) FILTER (dep) AS deps
  FROM bf GROUP BY symbol, kind, ar, br HAVING count(*) FILTER (rn < br AND ebeyond) = 0),
od AS (SELECT fx.*, nd.rn AS prn, nd.price AS pp, nd.slack AS ps, row_number() OVER (PARTITION BY fx.symbol, fx.kind, ar, br ORDER BY nd.rn) AS k
  FROM fx JOIN nd ON nd.symbol = fx.symbol AND nd.kind = fx.kind AND nd.rn > ar),
od2 AS MATERIALIZED (SELECT *, (broke IS NULL OR prn < broke) AND abs(pp - (ap + slope * (prn - ar))) <= ps AS ok FROM od),
st AS (SELECT symbol, kind, ar, br, 0::BIGINT AS k, ar AS lastt, 1::BIGINT AS touches, 0::BIGINT AS retests, false AS second FROM fx
  UNION ALL
  SELECT s.symbol, s.kind, s.ar, s.br, o.k, CASE WHEN h THEN o.prn ELSE s.lastt END, s.touches + h::BIGINT, s.retests + (h AND o.prn > s.br)::BIGINT, s.second OR (h AND o.prn = s.br)
  FROM st s JOIN od2 o ON o.symbol = s.symbol AND o.kind = s.kind AND o.ar = s.ar AND o.br = s.br AND o.k = s.k + 1,
  LATERAL (SELECT o.ok AND o.prn - s.lastt >= 4 AND coalesce(len(list_filter(o.deps, lambda x: x > s.lastt AND x < o.prn)) > 0, false) AS h)),
fin AS (SELECT symbol, kind, ar, br, arg_max(touches, k) AS touches, arg_max(retests, k) AS retests, arg_max(second, k) AS second FROM st GROUP BY ALL),
rk AS (SELECT fx.*, touches, retests, CASE WHEN broke IS NOT NULL THEN 'broken' WHEN retests > 0 THEN 'confirmed' ELSE 'candidate' END AS status FROM fin JOIN fx USING (symbol, kind, ar, br) WHERE second),
pl AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY CASE status WHEN 'confirmed' THEN 2 WHEN 'candidate' THEN 1 ELSE 0 END DESC, retests DESC, touches DESC, br DESC, gap DESC) AS place FROM rk)
SELECT symbol, kind, ar AS a_rn, br AS b_rn, at_ AS a_time, bt AS b_time, {q('ap')} AS a_price, {q('bp')} AS b_price, {q('ap + slope * (n - ar)')} AS projected,
  touches, retests, closes AS closes_beyond, broke AS first_break_rn, status, place FROM pl"""
TREND_COLS = ("symbol", "kind", "a_rn", "b_rn", "a_time", "b_time", "a_price", "b_price", "projected", "touches", "retests", "closes_beyond", "first_break_rn", "status", "place")


@query("trendline_candidates", over(f", {TREND_SQL}", "hourly", True))
def _(spark, d):
    return tidy(S.trendline_candidates(bars(spark, d, "hourly"), best_only=False), *TREND_COLS)


def base_sql(length: int) -> str:
    w = rows(length)
    return f"""SELECT symbol, rn, n, {length} AS len, {lag('atr', length)} AS a, min(low) {w} AS bl, max(high) {w} AS bh, min(least(open, close)) {w} AS kl, max(greatest(open, close)) {w} AS kh,
  max(span) {w} AS xs, min(span) {w} AS ns, max(CASE WHEN span > 0 THEN abs(close - open) / span END) {w} AS sh FROM za"""


ZONES_SQL = f"""
zt AS (SELECT *, {TR_SAFE} AS tr, high - low AS span FROM b),
za AS MATERIALIZED (SELECT *, CASE WHEN rn >= 14 THEN avg(tr) {rows(14)} END AS atr FROM zt),
zb AS ({' UNION ALL '.join(base_sql(k) for k in range(1, 7))}),
zc AS (SELECT * FROM zb WHERE rn - len >= 14 AND a > 0 AND ns > 0 AND xs / a <= 0.8 + 1e-12 AND sh <= 0.5 + 1e-12 AND (bh - bl) / a <= 1 + 1e-12),
zd AS (SELECT * FROM zc QUALIFY row_number() OVER (PARTITION BY symbol, rn ORDER BY len DESC) = 1),
ze AS (SELECT zd.*, i.rn AS ir, i.time AS it, i.close AS ic, i.open AS io, i.high - i.low AS isp, kind, CASE kind WHEN 'supply' THEN -1 ELSE 1 END AS sg
  FROM zd JOIN b i ON i.symbol = zd.symbol AND i.rn > zd.rn AND i.rn <= zd.rn + 3 AND i.rn < i.n, (VALUES ('supply'), ('demand')) k(kind)),
zf AS (SELECT *, bool_or(CASE kind WHEN 'supply' THEN ic > bh ELSE ic < bl END) OVER w AS dead,
  bool_or(sg * (ic - io) / a >= 0.8 AND isp > 0 AND sg * (ic - io) / nullif(isp, 0) >= 0.6) OVER w AS imp, CASE kind WHEN 'supply' THEN bl - ic ELSE ic - bh END / a AS disp
  FROM ze WINDOW w AS (PARTITION BY symbol, rn, kind ORDER BY ir)),
zg AS (SELECT *, CASE kind WHEN 'supply' THEN kl ELSE bl END AS zl, CASE kind WHEN 'supply' THEN bh ELSE kh END AS zh FROM zf WHERE NOT dead AND imp AND disp >= 1.5
  QUALIFY row_number() OVER (PARTITION BY symbol, rn, kind ORDER BY ir) = 1),
zh0 AS (SELECT symbol, kind, ir, it, a, disp, zl, zh, rn - len + 1 AS s, rn AS e, row_number() OVER (PARTITION BY symbol, kind, ir ORDER BY rn) AS k FROM zg WHERE zh > zl),
zp AS (SELECT symbol, kind, ir, max(s) FILTER (k = 1) AS s1, max(e) FILTER (k = 1) AS e1, max(s) FILTER (k = 2) AS s2, max(e) FILTER (k = 2) AS e2, max(s) FILTER (k = 3) AS s3, max(e) FILTER (k = 3) AS e3 FROM zh0 GROUP BY ALL),
-- after the second zone: first slot f, second slot g (null when merged or absent)
zq AS (SELECT *, CASE WHEN e2 IS NOT NULL AND s2 <= e1 AND e2 - s2 > e1 - s1 THEN e2 ELSE e1 END AS f, CASE WHEN e2 IS NOT NULL AND s2 > e1 THEN e2 END AS g FROM zp),
zr AS (SELECT *, CASE f WHEN e1 THEN s1 ELSE s2 END AS fs, s2 AS gs FROM zq),
zs AS (SELECT symbol, kind, ir, CASE WHEN e3 IS NOT NULL AND s3 <= f AND e3 >= fs AND e3 - s3 > f - fs THEN e3 ELSE f END AS k1,
  CASE WHEN g IS NOT NULL AND e3 IS NOT NULL AND s3 > f AND s3 <= g AND e3 - s3 > g - gs THEN e3 ELSE g END AS k2,
  CASE WHEN e3 IS NOT NULL AND s3 > f AND (g IS NULL OR s3 > g) THEN e3 END AS k3 FROM zr),
zone AS MATERIALIZED (SELECT z.* FROM zh0 z JOIN zs USING (symbol, kind, ir) WHERE z.e IN (k1, k2, k3))"""


@query("supply_demand_zones", over(f""", {ZONES_SQL} SELECT symbol, kind, {q('zl')} AS low, {q('zh')} AS high, s AS base_start, e AS base_end, ir AS confirmed, it AS confirmed_time,
{q('a')} AS atr, {q('disp')} AS displacement FROM zone"""))
def _(spark, d):
    return tidy(Z.supply_demand_zones(bars(spark, d)), "symbol", "kind", "low", "high", "base_start", "base_end", "confirmed", "confirmed_time", "atr", "displacement")


LIFE_SQL = f"""{ZONES_SQL},
la AS (SELECT z.*, i.rn, i.n, i.time, CASE kind WHEN 'supply' THEN i.close > zh ELSE i.close < zl END AS brk, i.high >= zl AND i.low <= zh AS ins
  FROM zone z LEFT JOIN b i ON i.symbol = z.symbol AND i.rn > ir AND i.rn < i.n),
lb AS (SELECT *, min(rn) FILTER (brk) OVER (PARTITION BY symbol, kind, e, ir) AS br, lag(ins) OVER (PARTITION BY symbol, kind, e, ir ORDER BY rn) AS was FROM la),
life AS (SELECT symbol, kind, s, e, ir, any_value(zl) AS zl, any_value(zh) AS zh, count(*) FILTER (ins AND NOT coalesce(was, false) AND (br IS NULL OR rn < br)) AS visits,
  max(time) FILTER (rn = br) AS gone, max(br) AS br FROM lb GROUP BY symbol, kind, s, e, ir),
life2 AS (SELECT *, CASE WHEN br IS NOT NULL THEN 'invalidated' WHEN visits > 0 THEN 'tested' ELSE 'fresh' END AS status FROM life)"""


@query("zone_lifecycle", over(f", {LIFE_SQL} SELECT symbol, kind, {q('zl')} AS low, {q('zh')} AS high, s AS base_start, e AS base_end, ir AS confirmed, status, visits AS test_count, gone AS invalidated_time FROM life2"))
def _(spark, d):
    return tidy(Z.zone_lifecycle(bars(spark, d)), "symbol", "kind", "low", "high", "base_start", "base_end", "confirmed", "status", "test_count", "invalidated_time")


@query("zone_topn", over(f""", {LIFE_SQL}, lc AS (SELECT symbol, close AS lastc FROM b WHERE rn = n - 1),
t AS (SELECT *, status = 'invalidated' AS gone_, greatest(zl - lastc, lastc - zh, 0) AS dist FROM life2 JOIN lc USING (symbol)),
u AS (SELECT *, row_number() OVER (PARTITION BY symbol, gone_ ORDER BY CASE WHEN gone_ THEN 0 ELSE dist END, ir DESC, kind, e DESC) AS place FROM t)
SELECT symbol, kind, {q('zl')} AS low, {q('zh')} AS high, ir AS confirmed, status, place FROM u WHERE place <= 12"""))
def _(spark, d):
    b = bars(spark, d)
    return tidy(Z.zone_topn(b, Z.zone_lifecycle(b)), "symbol", "kind", "low", "high", "confirmed", "status", "place")
