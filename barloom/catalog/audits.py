"""Audit checks as queries over rule-made trade lists."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, q, query, r, tidy
from barloom.catalog.ledgers import LEAKS
from barloom.operators import audit as A
from barloom.operators import rules as R
from barloom.session import cut_lineage
from barloom.sources import artifacts as S

c = F.col
TRADES = """
tr AS MATERIALIZED (SELECT b.symbol || '/' || variant AS artifact_id, b.rn * 32 + cp AS trade_no, b.symbol, b.time + INTERVAL 6 HOUR AS entry_time, x.time + INTERVAL 18 HOUR AS exit_time,
  CASE WHEN b.rn % 149 = 5 THEN 'long' ELSE 'short' END AS side, CASE WHEN variant = 'close' THEN b.close WHEN variant = 'wrong' AND b.rn % 2 = 0 THEN b.high * 3 ELSE b.open END AS entry_price, x.close AS exit_price
  FROM b JOIN b x ON x.symbol = b.symbol AND x.rn = b.rn + 7 + b.rn % 5, (VALUES ('open'), ('close'), ('copies'), ('wrong')) v(variant), range(0, 20) g(cp)
  WHERE b.rn % 149 IN (5, 80) AND (cp = 0 OR variant = 'copies'))"""
RET = "CASE WHEN side = 'long' THEN exit_price / entry_price - 1 ELSE 1 - exit_price / entry_price END"
WIN = "wn AS (SELECT artifact_id, any_value(symbol) AS symbol, min(entry_time) - INTERVAL 5 DAY AS start, max(exit_time) + INTERVAL 1 DAY AS \"end\" FROM tr GROUP BY artifact_id)"
PLACED = f"""{TRADES}, {WIN},
ww AS (SELECT wn.artifact_id, min(rn) AS first_rn, max(rn) AS last_rn, max(time) AS last_time FROM wn JOIN b ON b.symbol = wn.symbol AND b.time >= start AND b.time <= "end" GROUP BY wn.artifact_id),
p1 AS (SELECT tr.*, first_rn, last_rn, last_time, b.rn AS ern, b.low AS el, b.high AS eh, b.close AS ec FROM tr JOIN ww USING (artifact_id) ASOF LEFT JOIN b ON b.symbol = tr.symbol AND tr.entry_time >= b.time),
p2 AS (SELECT p1.*, b.rn AS xrn, b.low AS xl, b.high AS xh, b.close AS xc FROM p1 ASOF LEFT JOIN b ON b.symbol = p1.symbol AND p1.exit_time >= b.time),
pl AS MATERIALIZED (SELECT *, CASE WHEN ern >= first_rn AND entry_time < last_time + INTERVAL 1 DAY THEN ern END AS e, CASE WHEN xrn >= first_rn AND exit_time < last_time + INTERVAL 1 DAY THEN xrn END AS x, last_rn - first_rn + 1 AS wb FROM p2)"""
ISSUES = """
fi AS (SELECT *, e IS NULL OR x IS NULL AS outside, CASE WHEN e IS NULL THEN 'entry-outside-data' WHEN NOT (entry_price >= el * (1 - 1e-9) AND entry_price <= eh * (1 + 1e-9)) THEN 'impossible-entry-fill' END AS ei,
  CASE WHEN e IS NOT NULL THEN CASE WHEN x IS NULL THEN 'exit-outside-data' WHEN NOT (exit_price >= xl * (1 - 1e-9) AND exit_price <= xh * (1 + 1e-9)) THEN 'impossible-exit-fill' END END AS xi,
  coalesce(e = x, false) AS same_bar, coalesce(abs(entry_price - ec) <= 1e-9 * greatest(abs(entry_price), abs(ec), 1), false) AS close_fill FROM pl),
fv AS (SELECT artifact_id, count(*) AS checked, sum((coalesce(ei LIKE 'impossible%', false))::BIGINT + (coalesce(xi LIKE 'impossible%', false))::BIGINT)::BIGINT AS impossible, count(*) FILTER (outside) AS outside,
  count(*) FILTER (same_bar) AS same_bar, count(*) FILTER (close_fill) AS close_fills FROM fi GROUP BY artifact_id)"""
KEPT = """
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY artifact_id, side ORDER BY e, x, trade_no) AS k FROM pl WHERE e IS NOT NULL AND x IS NOT NULL),
gr AS (SELECT artifact_id, side, k, true AS keep, x AS till FROM od WHERE k = 1
  UNION ALL SELECT o.artifact_id, o.side, o.k, o.e > g.till, CASE WHEN o.e > g.till THEN o.x ELSE g.till END FROM gr g JOIN od o ON o.artifact_id = g.artifact_id AND o.side = g.side AND o.k = g.k + 1),
kp AS MATERIALIZED (SELECT od.* FROM od JOIN gr USING (artifact_id, side, k) WHERE keep),
ix AS (SELECT artifact_id, reported, mapped, coalesce(effective, 0) AS effective, CASE WHEN mapped = 0 THEN 0 ELSE 1 - coalesce(effective, 0) / mapped END AS overlap_ratio
  FROM (SELECT artifact_id, count(*) AS reported, count(*) FILTER (e IS NOT NULL AND x IS NOT NULL) AS mapped FROM pl GROUP BY artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS effective FROM kp GROUP BY artifact_id) USING (artifact_id))"""
IMUL = lambda a, b: f"((({a})::HUGEINT * ({b})) % 4294967296)::BIGINT"
SIMS = 1000
BASE = f"""
tm AS MATERIALIZED (SELECT *, greatest(1, x - e) AS hold, wb - 1 - greatest(1, x - e) AS most, row_number() OVER (PARTITION BY artifact_id ORDER BY e, x, trade_no) - 1 AS slot, count(*) OVER (PARTITION BY artifact_id) AS slots FROM kp WHERE wb >= 3),
sh AS (SELECT tm.artifact_id, avg(CASE WHEN side = 'long' THEN z.close / ec - 1 ELSE 1 - z.close / ec END) AS shadow_mean, avg({RET}) AS self_mean, count(*) AS trades_used
  FROM tm JOIN b z ON z.symbol = tm.symbol AND z.rn = first_rn + least(wb - 1, e - first_rn + hold) GROUP BY tm.artifact_id),
r0 AS (SELECT artifact_id, symbol, side, first_rn, hold, most, sim, ((sim * slots + slot + 1) * 1831565813 + 42) % 4294967296 AS t FROM tm, range(0, {SIMS}) s(sim)),
r1 AS (SELECT *, {IMUL('xor(t, t >> 15)', 't | 1')} AS u FROM r0),
r2 AS (SELECT *, xor(u, (u + {IMUL('xor(u, u >> 7)', 'u | 61')}) % 4294967296) AS v FROM r1),
r3 AS (SELECT *, first_rn + floor(xor(v, v >> 14) / 4294967296.0 * (most + 1))::BIGINT AS f FROM r2),
r4 AS (SELECT artifact_id, sim, avg(CASE WHEN side = 'long' THEN z.close / a.close - 1 ELSE 1 - z.close / a.close END) AS m FROM r3 JOIN b a ON a.symbol = r3.symbol AND a.rn = f JOIN b z ON z.symbol = r3.symbol AND z.rn = f + hold GROUP BY artifact_id, sim),
bl AS (SELECT artifact_id, any_value(trades_used) AS trades_used, count(*) AS simulations, count(*) FILTER (m < shadow_mean) / count(*) AS percentile, any_value(shadow_mean) AS shadow_mean, any_value(self_mean) AS self_mean, list_sort(list(m)) AS ms FROM r4 JOIN sh USING (artifact_id) GROUP BY artifact_id)"""
INV = NormalDist().inv_cdf
REACH = INV(0.975) + INV(0.8)
NEED = A.required_trades(0.05)
Z2 = A.Z95 * A.Z95
POWER = f"""
rt AS (SELECT artifact_id, {RET} AS r FROM kp),
g1 AS (SELECT artifact_id, count(*) AS n, count(*) FILTER (r > 0) AS wins, avg(r) AS mu, stddev_samp(r) AS sd FROM rt GROUP BY artifact_id),
pw AS (SELECT *, greatest(0, (wins / n + {Z2} / (2 * n)) / (1 + {Z2} / n) - {A.Z95} * sqrt(wins / n * (1 - wins / n) / n + {Z2} / (4.0 * n * n)) / (1 + {Z2} / n)) AS lo,
  least(1, (wins / n + {Z2} / (2 * n)) / (1 + {Z2} / n) + {A.Z95} * sqrt(wins / n * (1 - wins / n) / n + {Z2} / (4.0 * n * n)) / (1 + {Z2} / n)) AS hi, ceil(pow({REACH} * sd / abs(nullif(mu, 0)), 2))::BIGINT AS need_mean FROM g1)"""
STATUS = f"""
hd AS (SELECT DISTINCT artifact_id, artifact_id LIKE '%/close' AS costs FROM tr),
al AS (SELECT hd.artifact_id, costs, fv.*, ix.*, bl.*, pw.* FROM hd LEFT JOIN fv USING (artifact_id) LEFT JOIN ix USING (artifact_id) LEFT JOIN bl USING (artifact_id) LEFT JOIN pw USING (artifact_id)),
ck AS (SELECT artifact_id, 'fill-validation' AS "check", CASE WHEN impossible > 0 OR outside > 0 THEN 'error' WHEN same_bar / checked > 0.5 THEN 'not_proven' WHEN close_fills / checked >= 0.6 OR same_bar > 0 THEN 'warn' ELSE 'pass' END AS status FROM al
  UNION ALL SELECT artifact_id, 'independence', CASE WHEN mapped > 0 AND overlap_ratio > 0.9 THEN 'error' WHEN overlap_ratio > 0.3 THEN 'warn' ELSE 'pass' END FROM al
  UNION ALL SELECT artifact_id, 'random-baseline', CASE WHEN percentile IS NULL THEN 'skipped' WHEN percentile >= 0.95 THEN 'pass' ELSE 'not_proven' END FROM al
  UNION ALL SELECT artifact_id, 'fill-model', CASE WHEN self_mean IS NULL THEN 'skipped' WHEN self_mean - shadow_mean > 0.005 THEN 'not_proven' WHEN self_mean - shadow_mean > 0.001 THEN 'warn' ELSE 'pass' END FROM al
  UNION ALL SELECT artifact_id, 'sample-power', CASE WHEN coalesce(n >= {NEED} AND n >= need_mean, false) THEN 'pass' ELSE 'not_proven' END FROM al
  UNION ALL SELECT artifact_id, 'plausibility', CASE WHEN n > 50 AND lo > 0.9 THEN 'warn' ELSE 'pass' END FROM al
  UNION ALL SELECT artifact_id, 'costs', CASE WHEN costs THEN 'pass' ELSE 'warn' END FROM al
  UNION ALL SELECT artifact_id, 'lookahead-lint', ['error', 'warn', 'error', 'error', 'warn', 'warn', 'warn', 'pass', 'warn', 'pass'][(regexp_extract(artifact_id, '\\d+')::INT + length(artifact_id)) % 10 + 1] FROM hd)"""


def sql(body: str) -> str:
    return over(f", {body}", "brand", True)


ALL = f"{PLACED}, {ISSUES}, {KEPT}, {BASE}, {POWER}, {STATUS}"


def placed_of(spark, d):
    b = bars(spark, d)
    return A.place_trades(S.rule_trades(b), b), b


@query("audit_trade_return", sql(f"{TRADES} SELECT artifact_id, trade_no, {q(RET, 6)} AS r FROM tr"))
def _(spark, d):
    return S.rule_trades(bars(spark, d)).select("artifact_id", "trade_no", r(A.trade_return(), 6).alias("r"))


@query("audit_fetch_window", sql(f"""{TRADES}, {WIN} SELECT artifact_id, start, "end", count(b.rn) AS bars FROM wn JOIN b ON b.symbol = wn.symbol AND b.time >= start AND b.time <= "end" GROUP BY ALL"""))
def _(spark, d):
    placed, b = placed_of(spark, d)
    held = placed.groupBy("artifact_id").agg(F.max("window_bars").alias("bars"))
    return tidy(A.fetch_window(S.rule_trades(b)).join(held, "artifact_id").select("artifact_id", "start", "end", "bars"))


@query("bar_index_at", sql(f"{PLACED} SELECT artifact_id, trade_no, e AS entry_rn, x AS exit_rn FROM pl"))
def _(spark, d):
    return placed_of(spark, d)[0].select("artifact_id", "trade_no", "entry_rn", "exit_rn")


@query("audit_fill_issues", sql(f"{PLACED}, {ISSUES} SELECT artifact_id, trade_no, outside, ei AS entry_issue, xi AS exit_issue, same_bar, close_fill FROM fi"))
def _(spark, d):
    return A.fill_issues(placed_of(spark, d)[0]).select("artifact_id", "trade_no", "outside", "entry_issue", "exit_issue", "same_bar", "close_fill")


@query("audit_fill_validation", sql(f"{PLACED}, {ISSUES} SELECT * FROM fv"))
def _(spark, d):
    return A.fill_validation(placed_of(spark, d)[0])


def kept_of(spark, d):
    placed, b = placed_of(spark, d)
    placed = cut_lineage(placed)
    return placed, cut_lineage(A.independent_trades(placed)), b


@query("audit_independence", sql(f"{PLACED}, {KEPT} SELECT artifact_id, reported, mapped, effective, {q('overlap_ratio')} AS overlap_ratio FROM ix"))
def _(spark, d):
    placed, kept, _ = kept_of(spark, d)
    return tidy(A.independence(placed, kept))


@query("audit_random_baseline", sql(f"""{PLACED}, {KEPT}, {BASE} SELECT artifact_id, trades_used, simulations, {q('percentile')} AS percentile, {q('shadow_mean', 6)} AS shadow_mean, {q('self_mean', 6)} AS self_mean,
{q(f'ms[floor(0.05 * {SIMS - 1} + 0.5)::INT + 1]', 6)} AS p05, {q(f'ms[floor(0.5 * {SIMS - 1} + 0.5)::INT + 1]', 6)} AS p50, {q(f'ms[floor(0.95 * {SIMS - 1} + 0.5)::INT + 1]', 6)} AS p95 FROM bl"""))
def _(spark, d):
    _, kept, b = kept_of(spark, d)
    df = A.random_baseline(kept, b, SIMS)
    return df.select("artifact_id", "trades_used", "simulations", r("percentile").alias("percentile"), *[r(x, 6).alias(x) for x in ("shadow_mean", "self_mean", "p05", "p50", "p95")])


@query("audit_sample_power", sql(f"{PLACED}, {KEPT}, {POWER} SELECT artifact_id, n AS trades, wins, {q('wins / n')} AS win_rate, {q('lo')} AS ci_low, {q('hi')} AS ci_high, {NEED}::BIGINT AS required, need_mean AS required_mean, coalesce(n >= {NEED} AND n >= need_mean, false) AS powered FROM pw"))
def _(spark, d):
    _, kept, _b = kept_of(spark, d)
    return tidy(A.sample_power(kept), "artifact_id", "trades", "wins", "win_rate", "ci_low", "ci_high", "required", "required_mean", "powered")


def checks_of(spark, d):
    b = bars(spark, d)
    trades = S.rule_trades(b)
    headers = S.headers(trades)
    return A.audit(trades, headers, b, SIMS, lint=lint_of(headers))


# The strategy source of an artifact is one line of a fixed list, by its brand's number and variant.
def lint_of(headers):
    k = (F.regexp_extract("artifact_id", r"(\d+)", 1).cast("int") + F.length("artifact_id")) % len(LEAKS)
    return R.lint_lines(headers.select("artifact_id", F.get(F.array(*[F.lit(x) for x in LEAKS]), k).alias("line")))


def one_check(spark, d, check):
    """Only the parts that the check reads are computed."""
    if check == "costs":
        found = A.check_statuses(S.headers(S.rule_trades(bars(spark, d))))
    else:
        _, kept, b = kept_of(spark, d)
        parts = {"power": A.sample_power(kept)} if check == "plausibility" else {"gaps": A.mean_gaps(kept, b)}
        found = A.check_statuses(S.headers(S.rule_trades(b)), **parts)
    return found.filter(c("check") == check).drop("check")


for _name, _check in (("audit_fill_model", "fill-model"), ("audit_plausibility", "plausibility"), ("audit_costs", "costs")):
    query(_name, sql(f"{ALL} SELECT artifact_id, status FROM ck WHERE \"check\" = '{_check}'"))(lambda spark, d, check=_check: one_check(spark, d, check))


@query("audit_check_status", sql(f"{ALL} SELECT * FROM ck"))
def _(spark, d):
    return checks_of(spark, d)


@query("audit_verdict", sql(f"""{ALL} SELECT artifact_id, CASE WHEN bool_or(status = 'error') THEN 'DEFECTS_FOUND' WHEN bool_or(status = 'not_proven')
  OR count(*) FILTER (status <> 'skipped' AND "check" IN ('fill-validation', 'random-baseline', 'sample-power')) < 3 THEN 'NOT_PROVEN' ELSE 'NO_DEFECTS_FOUND' END AS verdict, count(*) FILTER (status = 'warn') AS warnings FROM ck GROUP BY artifact_id"""))
def _(spark, d):
    return A.verdicts(checks_of(spark, d))


# ---- artifacts as JSON text ------------------------------------------------------------------


def artifact_json(spark, d):
    """The rule trades as one JSON text per symbol, with a fault in four of five."""
    t = S.rule_trades(bars(spark, d)).filter(c("artifact_id").endswith("/open"))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.regexp_extract("symbol", r"(\d+)", 1).cast("int") % 5
    # A trade list belongs to one artifact; each is one bounded text.
    row = F.struct(
        F.when(k == 1, "not a time").otherwise(iso("entry_time")).alias("entryTime"), iso("exit_time").alias("exitTime"),
        F.when(k == 2, "flat").otherwise(c("side")).alias("side"), F.when(k == 3, -c("entry_price")).otherwise(c("entry_price")).alias("entryPrice"), c("exit_price").alias("exitPrice"),
    )
    g = t.groupBy("artifact_id", "symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("trade_no", row.alias("t")))), lambda x: x["t"]).alias("trades"))
    doc = F.struct(F.when(k == 4, 2).otherwise(1).alias("version"), "symbol", F.lit("1d").alias("timeframe"), "trades", F.struct(F.lit(True).alias("included")).alias("costs"))
    return g.select("artifact_id", "symbol", k.alias("k"), F.to_json(doc).alias("json"))


FAULT = "regexp_extract(symbol, '\\d+')::INT % 5"


@query("src_artifact_json", sql(f"""{TRADES} SELECT artifact_id, CASE {FAULT} WHEN 1 THEN 'trades[0].entryTime' WHEN 2 THEN 'trades[0].side' WHEN 3 THEN 'trades[0].entryPrice' WHEN 4 THEN 'version' END AS bad_field, count(*) AS trades
FROM tr WHERE artifact_id LIKE '%/open' GROUP BY ALL"""))
def _(spark, d):
    parsed = A.parse_artifacts(artifact_json(spark, d))
    return parsed.select("artifact_id", "bad_field", F.size("a.trades").cast("long").alias("trades"))


@query("src_artifact_trades", sql(f"""{TRADES} SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY trade_no) - 1 AS trade_no, symbol, '1d' AS timeframe, entry_time, exit_time, side,
{q('entry_price')} AS entry_price, {q('exit_price')} AS exit_price FROM tr WHERE artifact_id LIKE '%/open' AND {FAULT} = 0"""))
def _(spark, d):
    return tidy(A.artifact_trades(A.parse_artifacts(artifact_json(spark, d))))
