"""The screener as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, q, query, tidy
from barloom.catalog.indicators import CUTLER_VALUE, lag, prior, rows
from barloom.operators import screener as S


def screen_sql(source: str) -> str:
    return f"""
c1 AS (SELECT *, close - {lag('close')} AS chg FROM {source}),
c2 AS (SELECT *, sum(greatest(chg, 0)) {rows(14)} AS gain, sum(greatest(-chg, 0)) {rows(14)} AS loss,
  CASE WHEN rn >= 20 THEN avg(close) {rows(20)} END AS sma20, CASE WHEN rn >= 50 THEN avg(close) {rows(50)} END AS sma50,
  CASE WHEN rn >= 200 THEN avg(close) {rows(200)} END AS sma200,
  max(high) {prior(20)} AS high20, min(low) {prior(20)} AS low20, list_sort(list(volume) {prior(20)}) AS vols FROM c1),
c3 AS (SELECT *, {CUTLER_VALUE} AS rsi14, vols[len(vols) // 2 + 1] AS med FROM c2),
c4 AS (SELECT *, CASE WHEN med > 0 THEN volume / med WHEN med IS NOT NULL THEN 1.0 END AS volume_ratio,
  abs(close - open) AS body FROM c3),
m AS (
  SELECT *, 'bullish_alignment' AS pattern, least(100.0, floor(50 + (sma20 - sma200) / sma200 * 500 + 0.5)) AS score FROM c4
    WHERE rn >= 200 AND close > sma20 AND sma20 > sma50 AND sma50 > sma200
  UNION ALL SELECT *, 'bearish_alignment', least(100.0, floor(50 + (sma200 - sma20) / sma200 * 500 + 0.5)) FROM c4
    WHERE rn >= 200 AND close < sma20 AND sma20 < sma50 AND sma50 < sma200
  UNION ALL SELECT *, 'volume_breakout', least(100.0, floor(60 + volume_ratio * 10 + (close - high20) / high20 * 500 + 0.5)) FROM c4
    WHERE rn >= 25 AND close > high20 AND volume_ratio >= 1.8
  UNION ALL SELECT *, 'volume_breakdown', least(100.0, floor(60 + volume_ratio * 10 + (low20 - close) / low20 * 500 + 0.5)) FROM c4
    WHERE rn >= 25 AND close < low20 AND volume_ratio >= 1.8
  UNION ALL SELECT *, 'oversold_reversal', least(100.0, floor((35 - rsi14) * 2 + 60 + 0.5)) FROM c4
    WHERE rn >= 20 AND rsi14 <= 32 AND (close > open OR least(open, close) - low > body * 1.5)
  UNION ALL SELECT *, 'overbought_reversal', least(100.0, floor((rsi14 - 65) * 2 + 60 + 0.5)) FROM c4
    WHERE rn >= 20 AND rsi14 >= 68 AND (close < open OR high - greatest(open, close) > body * 1.5))"""


RECENT = """
rec AS (SELECT * REPLACE (rn - greatest(n - 220, 0) AS rn, least(n, 220) AS n) FROM b WHERE rn > n - 220)"""


def single(pattern: str):
    sql = over(f", {screen_sql('b')} SELECT symbol, time, {q('close')} AS close, score FROM m WHERE pattern = '{pattern}'")

    def run(spark, d):
        hits = S.matches_of(S.screen_columns(bars(spark, d)), (pattern,))
        return tidy(hits, "symbol", "time", "close", "score")

    return sql, run


for _name, _pattern in (
    ("screen_bullish_alignment", "bullish_alignment"),
    ("screen_bearish_alignment", "bearish_alignment"),
    ("screen_volume_breakout", "volume_breakout"),
    ("screen_volume_breakdown", "volume_breakdown"),
    ("screen_oversold", "oversold_reversal"),
    ("screen_overbought", "overbought_reversal"),
):
    _sql, _run = single(_pattern)
    query(_name, _sql)(_run)


@query("screen_universe", over(f""", {RECENT}, r2 AS (SELECT * FROM rec WHERE n >= 30), {screen_sql('r2')}
SELECT symbol, time, pattern, score, {q('close')} AS close, {q('rsi14')} AS rsi14, {q('volume_ratio')} AS volume_ratio FROM m WHERE rn = n"""))
def _(spark, d):
    return tidy(S.screen_universe(bars(spark, d)), "symbol", "time", "pattern", "score", "close", "rsi14", "volume_ratio")


@query("screen_history", over(f", {screen_sql('b')} SELECT symbol, time, pattern, score FROM m"))
def _(spark, d):
    return tidy(S.matches_of(S.screen_columns(bars(spark, d))), "symbol", "time", "pattern", "score")


@query("screen_metrics", over(f""", {RECENT}, {screen_sql('rec')},
o(pattern, pos) AS (VALUES ('bullish_alignment', 1), ('volume_breakout', 2), ('oversold_reversal', 3), ('bearish_alignment', 4), ('volume_breakdown', 5), ('overbought_reversal', 6)),
g AS (SELECT symbol, string_agg(pattern, ',' ORDER BY pos) AS matches FROM m JOIN o USING (pattern) WHERE rn = n GROUP BY symbol)
SELECT symbol, time, {q('close')} AS close, {q('sma20')} AS sma20, {q('sma50')} AS sma50, {q('sma200')} AS sma200, {q('high20')} AS high20,
  {q('low20')} AS low20, {q('volume_ratio')} AS volume_ratio, {q('rsi14')} AS rsi14, matches FROM c4 LEFT JOIN g USING (symbol) WHERE rn = n"""))
def _(spark, d):
    return tidy(S.screen_metrics(bars(spark, d)), "symbol", "time", "close", "sma20", "sma50", "sma200", "high20",
                "low20", "volume_ratio", "rsi14", "matches")
