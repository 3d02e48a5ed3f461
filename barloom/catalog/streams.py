"""Streaming jobs run to the end of the event table and compared with their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.catalog.bars import OHLCV, OHLCV_SQL
from barloom.catalog.base import BARS_SQL, bars, over, q, query, r, tidy
from barloom.catalog.signals import SIG, st_ctes
from barloom.session import shared_folder
from barloom.sources.bars import table
from barloom.streaming import jobs as J

c = F.col


PARTS, LATE = 6, "12 days"  # a part holds five days of the event table, and rows come up to two parts late
FILE_ROWS = 100_000  # about, in a file of a large table; a part has two files at least


def stored_stream(spark, df, at="time", key="symbol"):
    """A table as a file stream in six parts of time, one row in seven a part late, and two later signs of life.

    The signs of life carry the key ``~`` and only move the watermark past all rows.
    """
    path = f"{shared_folder(spark)}/stream-in-{uuid.uuid4().hex}"
    micros = F.unix_micros(c(at))
    lo, hi, n = df.agg(F.min(micros), F.max(micros), F.count(F.lit(1))).first()
    span, files = hi - lo + 1, max(2, n // (PARTS * FILE_ROWS))
    part = F.floor((micros - lo) * PARTS / span) + F.when(F.pmod(F.xxhash64(*df.columns), F.lit(7)) == 0, 1).otherwise(0)
    placed = df.withColumn("_part", part)
    for k in range(PARTS + 1):
        placed.filter(c("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(path)
    for k in (2, 3):
        df.limit(1).withColumns({at: F.timestamp_micros(F.lit(lo + k * span)), key: F.lit("~")}).select(df.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def ticks_stream(spark, d):
    """The event table as a file stream."""
    ticks = table(spark, d, "events").select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"), c("value").alias("quantity"),
                                             c("event_id").alias("seq"), "user_id")
    return stored_stream(spark, ticks, "ts")


def drain(spark, stream, mode="append", key="symbol"):
    """Run until the input is used up; a batch writes its own folder, so that a retried one replaces itself."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/_n={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    kept = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out").withColumn("_batch", F.regexp_extract(F.input_file_name(), r"_n=(\d+)/", 1).cast("int"))
    return kept.filter(c(key) != "~")


@query("stream_bars", over(f"SELECT symbol, time, {OHLCV_SQL} FROM b", "hourly"))
def _(spark, d):
    out = drain(spark, J.stream_bars(ticks_stream(spark, d), "1h", "1 hour", LATE), "update")
    newest = out.groupBy("symbol", "time").agg(F.max_by(F.struct(*OHLCV), "_batch").alias("v")).select("symbol", "time", "v.*")
    return tidy(newest, "symbol", "time", *OHLCV)


# Each bar is sent once, when the watermark has passed its end.
@query("stream_closed_only", over(f"SELECT symbol, time, {OHLCV_SQL} FROM b", "hourly"))
def _(spark, d):
    out = drain(spark, J.stream_bars(ticks_stream(spark, d), "1h", "1 hour", LATE), "append")
    return tidy(out, "symbol", "time", *OHLCV)


@query("stream_upsert_bars", over(f"SELECT symbol, time, {q('CASE WHEN rn % 3 = 0 THEN close * 2 ELSE close END')} AS close FROM b", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly").select("symbol", "timeframe", "time", "rn", "close")
    both = b.withColumn("seq", F.lit(1)).unionByName(b.filter(c("rn") % 3 == 0).withColumns({"close": c("close") * 2, "seq": F.lit(2)}))
    out = drain(spark, J.stream_upsert_bars(stored_stream(spark, both), LATE), "update")
    newest = out.groupBy("symbol", "time").agg(F.max_by("close", F.struct("_batch", "seq")).alias("close"))
    return tidy(newest, "symbol", "time", "close")


@query("stream_alerts", over("SELECT DISTINCT symbol, time, time::VARCHAR || '|big' AS alert_id FROM b WHERE high > 2 * close", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly").filter(c("high") > 2 * c("close"))
    a = b.select("symbol", "time", F.concat(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit("|big")).alias("alert_id"))
    out = drain(spark, J.stream_alerts(stored_stream(spark, a.unionByName(a)), LATE))
    return tidy(out, "symbol", "time", "alert_id")


@query("stream_funding_monitor", over(f"SELECT symbol, time, {q('(close - open) / nullif(close + open, 0) / 1000', 8)} AS funding_rate FROM b WHERE abs((close - open) / nullif(close + open, 0) / 1000 * 100) >= 0.03", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly").select("symbol", "time", F.expr("(close - open) / nullif(close + open, 0) / 1000").alias("funding_rate"))
    return tidy(drain(spark, J.stream_funding_monitor(stored_stream(spark, b))), "symbol", "time", "funding_rate", digits=8)


def closed_bars(spark, d):
    b = bars(spark, d, "hourly").filter(c("rn") < c("n")).select("symbol", "timeframe", "time", *OHLCV)
    return stored_stream(spark, b)


@query("stream_supertrend", over(f""", {st_ctes(60, 4.0)}
SELECT b.symbol, b.time, {q('CASE WHEN down THEN upper ELSE lower END')} AS st_value, CASE WHEN down IS NULL THEN NULL WHEN down THEN 'bearish' ELSE 'bullish' END AS st_direction
FROM b LEFT JOIN st USING (symbol, rn) WHERE b.rn < b.n""", "hourly", True))
def _(spark, d):
    out = drain(spark, J.stream_fold(closed_bars(spark, d), J.SuperTrendProcessor(), LATE))
    return tidy(out, "symbol", "time", "st_value", "st_direction")


ZIGZAG = f"""z AS (SELECT DISTINCT symbol, lv, level, 0::BIGINT AS rn, true AS up, first(high) OVER (PARTITION BY symbol ORDER BY rn) AS px, false AS turn, 0.0::DOUBLE AS mark FROM b, (VALUES (0.007::DOUBLE, 'fine'), (0.02::DOUBLE, 'big')) v(lv, level)
  UNION ALL SELECT i.symbol, z.lv, z.level, i.rn, CASE WHEN tn THEN NOT z.up ELSE z.up END, CASE WHEN tn THEN CASE WHEN z.up THEN i.low ELSE i.high END ELSE p2 END, tn, p2
  FROM z JOIN b i ON i.symbol = z.symbol AND i.rn = z.rn + 1 AND i.rn < i.n, LATERAL (SELECT CASE WHEN z.up THEN greatest(z.px, i.high) ELSE least(z.px, i.low) END AS p2),
  LATERAL (SELECT CASE WHEN z.up THEN (p2 - i.low) / p2 >= z.lv ELSE (i.high - p2) / p2 >= z.lv END AS tn))"""


@query("stream_zigzag", over(f", {ZIGZAG} SELECT z.symbol, b.time, level, NOT up AS is_top, {q('mark')} AS price FROM z JOIN b USING (symbol, rn) WHERE turn", "hourly", True))
def _(spark, d):
    return tidy(drain(spark, J.stream_fold(closed_bars(spark, d), J.ZigzagProcessor(), LATE)), "symbol", "time", "level", "is_top", "price")


@query("stream_signals", over(f", {SIG} SELECT symbol, rn, time, side, kind, {q('entry')} AS entry, status, closed_rn FROM ez WHERE closed_rn IS NOT NULL", "hourly", True))
def _(spark, d):
    out = drain(spark, J.stream_fold(closed_bars(spark, d), J.SignalProcessor(), LATE))
    return tidy(out, "symbol", "rn", "time", "side", "kind", "entry", "status", "closed_rn")


@query("stream_walls_ttl", f"""WITH u AS (SELECT user_id::VARCHAR AS id, ts, value * 1000 AS usd, ts - lag(ts) OVER k > INTERVAL 6 HOUR AS apart FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts)),
l AS (SELECT *, sum(coalesce(apart, true)::INT) OVER (PARTITION BY id ORDER BY ts) AS life FROM u)
SELECT id, min(ts) AS since, max(ts) AS last_seen, max(ts) + INTERVAL 6 HOUR AS gone_at, count(*) AS updates, {q('max(usd)')} AS most_usd FROM l GROUP BY id, life""")
def _(spark, d):
    updates = table(spark, d, "events").select(c("user_id").cast("string").alias("id"), c("ts").cast("timestamp").alias("ts"), (c("value") * 1000).alias("usd"))
    out = drain(spark, J.stream_walls_ttl(stored_stream(spark, updates, "ts", "id"), "6 hours", LATE), key="id")
    return tidy(out, "id", "since", "last_seen", "gone_at", "updates", "most_usd")


# Orders of each symbol's users, sells by odd users; an order rests at a multiple of the value told last, and the hourly
# bars of its symbol meet it. The oracle looks for the first sweeping bar between a word and the next or the time to live.
REST = "value * CASE WHEN user_id % 2 = 1 THEN 1.5 ELSE 0.5 END"


@query("stream_walls_swept", over(f""", w AS (SELECT event_type AS symbol, user_id::VARCHAR AS id, user_id % 2 = 1 AS sell, ts, max({REST}) AS price, max(value * 1000) AS usd, count(*) AS n FROM events GROUP BY ALL),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY symbol, id ORDER BY ts) AS later FROM w),
sw AS (SELECT nx.symbol, nx.id, nx.ts, min(b.time) AS swept FROM nx JOIN b ON b.symbol = nx.symbol AND b.time >= nx.ts AND b.time < nx.ts + INTERVAL 40 HOUR AND (nx.later IS NULL OR b.time < nx.later)
  AND CASE WHEN sell THEN b.high > price * 1.0005 ELSE b.low < price * 0.9995 END GROUP BY ALL),
en AS (SELECT nx.*, swept, swept IS NOT NULL OR later IS NULL OR later - ts >= INTERVAL 40 HOUR AS ends FROM nx LEFT JOIN sw USING (symbol, id, ts)),
lf AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY symbol, id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM en)
SELECT symbol, id, CASE WHEN any_value(sell) THEN 'sell' ELSE 'buy' END AS side, {q('arg_max(price, ts)')} AS price, min(ts) AS since, max(ts) AS last_seen, coalesce(max(swept), max(ts) + INTERVAL 40 HOUR) AS gone_at,
  CASE WHEN max(swept) IS NULL THEN 'expired' ELSE 'swept' END AS reason, sum(n)::BIGINT AS updates, {q('max(usd)')} AS most_usd FROM lf GROUP BY symbol, id, life""", "hourly"))
def _(spark, d):
    sell = c("user_id") % 2 == 1
    updates = table(spark, d, "events").select(
        c("event_type").alias("symbol"), c("user_id").cast("string").alias("id"), F.when(sell, "sell").otherwise("buy").alias("side"),
        (c("value") * F.when(sell, 1.5).otherwise(0.5)).alias("price"), (c("value") * 1000).alias("usd"), c("ts").cast("timestamp").alias("time"),
    )
    reach = bars(spark, d, "hourly").select("symbol", c("time").cast("timestamp").alias("time"), "high", "low")
    lives = J.stream_wall_lives(stored_stream(spark, updates), stored_stream(spark, reach), 40 * 3600, LATE)
    return tidy(drain(spark, lives), "symbol", "id", "side", "price", "since", "last_seen", "gone_at", "reason", "updates", "most_usd")
