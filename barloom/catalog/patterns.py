"""Candlestick patterns as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.bars import group_sql
from barloom.catalog.base import bars, over, q, query, tidy
from barloom.catalog.indicators import P, ema_sql, lag, rows, scan_sql
from barloom.operators import patterns as K


def facts_sql(source: str = "b", lags: int = K.LAGS) -> str:
    named = ", ".join(f"{long} AS {s}" for long, s in K.SHORT.items())
    back = ", ".join(f"{lag(long, k)} AS {s}{k}" for k in range(1, lags + 1) for long, s in K.SHORT.items())
    ext = ", ".join(
        f"CASE WHEN rn >= {skip + n} THEN {'max' if side == 'high' else 'min'}({side}) {P} ROWS BETWEEN {skip + n - 1} PRECEDING AND {skip} PRECEDING) END AS {side}_{skip}_{n}"
        for side, skip, n in K.EXTREMES
    )
    parts = ", ".join(f"{text} AS {name}" for name, text in K.PARTS.items())
    return f"kf AS (SELECT symbol, time, rn, n, {named}, {back}, {ext} FROM {source}), kp AS (SELECT *, {parts} FROM kf)"


def flags_sql(rules: dict) -> str:
    return ", ".join(f"coalesce({text}, false) AS {name}" for name, text in rules.items())


@query("kpattern_15", over(f", {facts_sql()} SELECT symbol, time, {flags_sql(K.CLASSIC)} FROM kp"))
def _(spark, d):
    return tidy(K.candle_patterns(bars(spark, d), K.CLASSIC), "symbol", "time", *K.CLASSIC)


@query("kpattern_19", over(f", {facts_sql()} SELECT symbol, time, {flags_sql(K.FURTHER)} FROM kp"))
def _(spark, d):
    return tidy(K.candle_patterns(bars(spark, d), K.FURTHER), "symbol", "time", *K.FURTHER)


HITS = " UNION ALL ".join(
    f"SELECT symbol, time, {i + 1} AS position, '{name}' AS pattern FROM kp WHERE coalesce({text}, false)"
    for i, (name, text) in enumerate(K.ALL_PATTERNS.items())
)


@query("kpattern_hits", over(f", {facts_sql()} {HITS}"))
def _(spark, d):
    return tidy(K.pattern_hits(K.candle_patterns(bars(spark, d))), "symbol", "time", "position", "pattern")


def coarse_sql(bucket: str, ma: str) -> str:
    return f"""
g AS ({group_sql(bucket)}),
h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS rn, bucket = max(bucket) OVER (PARTITION BY symbol) AS forming FROM g),
{ma},
hk AS (SELECT *, {', '.join(f'{long} AS {s}' for long, s in K.SHORT.items())}, {', '.join(f'{lag(long, k)} AS {s}{k}' for k in range(1, 5) for long, s in K.SHORT.items())},
  {', '.join(f"{lag('ma', k)} AS ma{k}" for k in range(1, 5))} FROM hm)"""


SMA14 = f"hm AS (SELECT *, CASE WHEN rn >= 14 THEN avg(close) {rows(14)} END AS ma FROM h)"
EMA14 = f"""he AS (SELECT *, {ema_sql(14)} AS eb FROM h), {scan_sql('hy', 'he', {'v': (1 - 2 / 15, 'eb')})},
hm AS (SELECT h.*, CASE WHEN rn >= 14 THEN v END AS ma FROM h JOIN hy USING (symbol, rn))"""


@query("htf_patterns", over(f", {coarse_sql(chr(39).join(['date_trunc(', 'week', ', time)']), SMA14)} SELECT symbol, bucket::TIMESTAMP AS time, {q('ma')} AS ma, {flags_sql(K.TREND_PATTERNS)} FROM hk WHERE NOT forming"))
def _(spark, d):
    return tidy(K.htf_patterns(bars(spark, d), "W"), "symbol", "time", "ma", *K.TREND_PATTERNS)


@query("htf_patterns_ema", over(f", {coarse_sql('make_timestamp((epoch_us(time) // 7200000000) * 7200000000)', EMA14)} SELECT symbol, bucket::TIMESTAMP AS time, {q('ma')} AS ma, {flags_sql(K.TREND_PATTERNS)} FROM hk WHERE NOT forming", "hourly", True))
def _(spark, d):
    return tidy(K.htf_patterns(bars(spark, d, "hourly"), "120", method="EMA"), "symbol", "time", "ma", *K.TREND_PATTERNS)
