"""The alert ledger of two runs and the alerts of the last closed bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, query, tidy
from barloom.catalog.indicators import NW, P, VB, lag
from barloom.catalog.patterns import SMA14, coarse_sql, facts_sql
from barloom.catalog.reports import REV_IN, oi_of
from barloom.operators import alerts as A
from barloom.operators import patterns as K

c = F.col
cases = lambda flags: " UNION ALL ".join(f"SELECT symbol, time, rn, '{code}' AS code FROM x WHERE {on}" for code, on in flags.items())
# Every family stands in a query of its own, so that helper tables of one do not meet those of another.
_OF = {
    "kp": (facts_sql(), "x AS (SELECT * FROM kp)", {f"kp.{x}": f"coalesce({K.CLASSIC[x]}, false)" for x in K.CLASSIC}),
    "td": (
        f"""t1 AS (SELECT *, coalesce(close > {lag('close', 4)}, false) AS u, coalesce(close < {lag('close', 4)}, false) AS dn FROM b),
t2 AS (SELECT *, max(CASE WHEN NOT u THEN rn END) {P}) AS su, max(CASE WHEN NOT dn THEN rn END) {P}) AS sd FROM t1)""",
        "x AS (SELECT *, CASE WHEN u THEN rn - coalesce(su, 0) ELSE 0 END AS up, CASE WHEN dn THEN rn - coalesce(sd, 0) ELSE 0 END AS dc FROM t2)",
        {f"td.{s}{k}": f"{x} = {k}" for k in (9, 13) for s, x in (("up", "up"), ("dn", "dc"))},
    ),
    "nw": (
        NW,
        f"""x AS (SELECT *, coalesce({lag('nw')} < {lag('nw', 2)} AND nw > {lag('nw')}, false) AS tb, coalesce({lag('nw')} > {lag('nw', 2)} AND nw < {lag('nw')}, false) AS ts,
  coalesce(close > up AND {lag('close')} <= {lag('up')}, false) AS cu, coalesce(close < lo AND {lag('close')} >= {lag('lo')}, false) AS cd FROM nwf)""",
        {"nw.turned_bullish": "tb", "nw.turned_bearish": "ts", "nw.trend_changed": "tb OR ts", "nw.band_cross_up": "cu", "nw.band_cross_dn": "cd"},
    ),
    "vb": (
        VB,
        f"""x AS (SELECT *, wu AND NOT coalesce({lag('wu')}, false) AS us, wd AND NOT coalesce({lag('wd')}, false) AS ds, coalesce({lag('sqz')}, false) AND NOT sqz AND coalesce(close > basis, false) AS fu,
  coalesce({lag('sqz')}, false) AND NOT sqz AND coalesce(close < basis, false) AS fd, coalesce(NOT trend AND (({lag('close')} > {lag('bu')} AND close < bu) OR ({lag('close')} < {lag('bl')} AND close > bl)), false) AS mr FROM v3)""",
        {"vb.walk_up_start": "us", "vb.walk_dn_start": "ds", "vb.fire_up": "fu", "vb.fire_dn": "fd", "vb.mr": "mr"},
    ),
    "rp": (REV_IN, "x AS (SELECT fm.symbol, fm.rn, ft, bt, bu, r3.time FROM fm JOIN r3 USING (symbol, rn))", {"rp.fine_confirmed": "ft", "rp.big_confirmed": "bt", "rp.c_fired": "bu"}),
}
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN coalesce({text}, false) THEN 'htf.{x}' END" for x, text in K.TREND_PATTERNS.items()) + ")"
_DAYS = coarse_sql("date_trunc('day', time)", SMA14)
# (symbol, time, code, run of the first of two that can see it, whether it is on the newest closed bar)
ALERTS = "al AS (" + " UNION ALL ".join(
    f"SELECT a.symbol, a.time, code, '{name}' AS family, CASE WHEN a.rn < n // 2 THEN 1 ELSE 2 END AS run, a.rn = n - 1 AS newest FROM (WITH RECURSIVE {head.strip().lstrip(',')}, {last} {cases(flags)}) a JOIN b ON b.symbol = a.symbol AND b.rn = a.rn WHERE a.rn < n"
    for name, (head, last, flags) in _OF.items()
) + f""" UNION ALL SELECT a.symbol, bucket::TIMESTAMP, code, 'htf', CASE WHEN bucket < half THEN 1 ELSE 2 END, bucket = max(bucket) OVER (PARTITION BY a.symbol)
  FROM (WITH {_DAYS.strip()} SELECT symbol, bucket, {_FIRST} AS code FROM hk WHERE NOT forming) a JOIN (SELECT symbol, date_trunc('day', max(time) FILTER (rn = n // 2)) AS half FROM b GROUP BY symbol) USING (symbol))"""


@query("alert_ledger", over(f", {ALERTS} SELECT symbol, time, strftime(time, '%Y-%m-%dT%H:%M:%S.000Z') || '|' || code AS alert_id, family, run::BIGINT AS raised_in FROM al WHERE code IS NOT NULL", "hourly", True))
def _(spark, d):
    b, oi = bars(spark, d, "hourly"), oi_of(spark, d)
    # The first run sees the older half of each symbol's bars, the second sees all and adds what is new.
    half = b.filter(c("rn") <= F.expr("n div 2")).withColumn("n", F.expr("n div 2"))
    ledger, _ = A.extend_ledger(None, A.raise_alerts(half, 3600, last_closed_only=False, oi=oi), 1)
    ledger, _ = A.extend_ledger(ledger, A.raise_alerts(b, 3600, last_closed_only=False, oi=oi), 2)
    return tidy(ledger, "symbol", "time", "alert_id", "family", "raised_in")


@query("alerts_last_closed", over(f", {ALERTS} SELECT symbol, time, strftime(time, '%Y-%m-%dT%H:%M:%S.000Z') || '|' || code AS alert_id, family FROM al WHERE code IS NOT NULL AND newest", "hourly", True))
def _(spark, d):
    return tidy(A.raise_alerts(bars(spark, d, "hourly"), 3600, oi=oi_of(spark, d)), "symbol", "time", "alert_id", "family")
