"""Sources, resampling and range queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS_SQL, bars, floor_sql, over, q, query, tidy
from barloom.catalog.indicators import lag, rows, rsi_ctes, rsi_value
from barloom.operators import indicators as I
from barloom.operators import resample as R

OHLCV = ("open", "high", "low", "close", "volume")
OHLCV_SQL = ", ".join(f"{q(x)} AS {x}" for x in OHLCV)
c = F.col


@query("bars_from_ticks", over(f"SELECT symbol, timeframe, time, {OHLCV_SQL}, rn, n FROM b"))
def _(spark, d):
    return tidy(bars(spark, d), "symbol", "timeframe", "time", *OHLCV, "rn", "n")


@query("bars_event_hourly", over(f"SELECT symbol, timeframe, time, {OHLCV_SQL}, rn, n FROM b", "hourly"))
def _(spark, d):
    return tidy(bars(spark, d, "hourly"), "symbol", "timeframe", "time", *OHLCV, "rn", "n")


@query("bars_order_daily", over(f"SELECT symbol, timeframe, time, {OHLCV_SQL}, rn, n FROM b", "orders"))
def _(spark, d):
    return tidy(bars(spark, d, "orders"), "symbol", "timeframe", "time", *OHLCV, "rn", "n")


def group_sql(bucket: str, source: str = "b") -> str:
    return f"""SELECT symbol, {bucket} AS bucket, arg_min(open, time) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, time) AS close, sum(volume) AS volume, min(time) AS first_time, max(time) AS last_time, count(*) AS bars
  FROM {source} GROUP BY symbol, {bucket}"""


@query("resample_htf", over(f""", g AS ({group_sql(floor_sql(14400, 'time'))}), e AS (SELECT symbol, max(time) AS e FROM b GROUP BY symbol)
SELECT symbol, bucket, bucket + INTERVAL 4 HOUR AS close_time, {OHLCV_SQL} FROM g JOIN e USING (symbol)
WHERE bucket + INTERVAL 4 HOUR <= e + INTERVAL 1 HOUR""", "hourly"))
def _(spark, d):
    return tidy(R.resample_htf(bars(spark, d, "hourly"), 14400, 3600), "symbol", "bucket", "close_time", *OHLCV)


@query("resample_calendar", over(f""", g AS (
SELECT 'D' AS unit, * FROM ({group_sql("date_trunc('day', time)")}) UNION ALL SELECT 'W', * FROM ({group_sql("date_trunc('week', time)")})
UNION ALL SELECT 'M', * FROM ({group_sql("date_trunc('month', time)")}) UNION ALL SELECT '120', * FROM ({group_sql(floor_sql(7200, 'time'))}))
SELECT symbol, unit, bucket::TIMESTAMP AS bucket, {OHLCV_SQL}, first_time, last_time, bucket = max(bucket) OVER (PARTITION BY symbol, unit) AS forming FROM g""", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly")
    parts = [R.resample_calendar(b, u).withColumn("unit", F.lit(u)) for u in ("D", "W", "M", "120")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tidy(out, "symbol", "unit", "bucket", *OHLCV, "first_time", "last_time", "forming")


@query("resample_gap_aware", over(f""", g AS ({group_sql(floor_sql(3600, 'time'))}),
x AS (SELECT *, CASE WHEN last_time + INTERVAL 15 MINUTE >= bucket + INTERVAL 1 HOUR THEN last_time
  ELSE lead(first_time) OVER (PARTITION BY symbol ORDER BY bucket) END AS confirm_time FROM g)
SELECT symbol, bucket, {OHLCV_SQL}, confirm_time FROM x WHERE confirm_time IS NOT NULL""", "quarter"))
def _(spark, d):
    return tidy(R.resample_gap_aware(bars(spark, d, "quarter"), 3600, 900), "symbol", "bucket", *OHLCV, "confirm_time")


@query("resample_hours_sum", over(f""", g AS ({group_sql(floor_sql(14400, 'time'))}) SELECT symbol, bucket, {OHLCV_SQL} FROM g""", "hourly"))
def _(spark, d):
    return tidy(R.group_bars(bars(spark, d, "hourly"), R.utc_floor(14400)), "symbol", "bucket", *OHLCV)


@query("resample_count", over(f""", g AS ({group_sql('(rn - 1) // 6')}) SELECT symbol, bucket, {OHLCV_SQL}, first_time, last_time FROM g WHERE bars = 6"""))
def _(spark, d):
    return tidy(R.resample_count(bars(spark, d), 6), "symbol", "bucket", *OHLCV, "first_time", "last_time")


@query("agg_infer_period", over(f""", x AS (SELECT symbol, epoch_us(time) - epoch_us({lag('time')}) AS gap FROM b)
SELECT symbol, coalesce(min(CASE WHEN gap > 0 THEN gap END) / 1000000.0, 60.0) AS period_seconds FROM x GROUP BY symbol""", "quarter"))
def _(spark, d):
    return R.chart_seconds(bars(spark, d, "quarter")).select("symbol", "period_seconds")


SPAN = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("src_range_limit", over(f""", w AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM b
WHERE time >= '{SPAN[0]}'::TIMESTAMP AND time <= '{SPAN[1]}'::TIMESTAMP)
SELECT symbol, time, {OHLCV_SQL}, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM w WHERE k <= 100""", "hourly"))
def _(spark, d):
    return tidy(R.range_limit(bars(spark, d, "hourly"), *SPAN, 100), "symbol", "time", *OHLCV, "rn")


@query("ohlcv_with_indicators", over(f""", w0 AS (SELECT * EXCLUDE (rn, n), row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM b0
WHERE time >= '{SPAN[0]}'::TIMESTAMP AND time <= '{SPAN[1]}'::TIMESTAMP),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn FROM w0 WHERE k <= 200), {rsi_ctes(14)}
SELECT symbol, time, {OHLCV_SQL}, CASE WHEN rn >= 20 THEN {q(f'avg(close) {rows(20)}')} END AS sma20,
  CASE WHEN rn >= 50 THEN {q(f'avg(close) {rows(50)}')} END AS sma50, {q(rsi_value(14, 'rs'))} AS rsi14
FROM b JOIN rs USING (symbol, rn)""", "hourly", True).replace("b AS MATERIALIZED", "b0 AS MATERIALIZED", 1))
def _(spark, d):
    cut = R.range_limit(bars(spark, d, "hourly"), *SPAN, 200)
    f = R.frame(cut, I.rsi_rows(14) + 50)
    for w in (20, 50):
        f = I.sma_stage(f, w, f"sma{w}")
    return tidy(I.rsi_stage(f, 14, "rsi14").rows(), "symbol", "time", *OHLCV, "sma20", "sma50", "rsi14")
