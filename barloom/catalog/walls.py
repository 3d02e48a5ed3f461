"""Large-order queries over walls made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, q, query, r, tidy
from barloom.operators import walls as W
from barloom.sources import flows

c = F.col
WL = """wl AS MATERIALIZED (SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 5 = 0 THEN 'OKX' WHEN event_id % 5 < 3 THEN 'Binance' ELSE 'Bybit' END AS exchange, CASE WHEN user_id % 4 = 0 THEN 'spot' ELSE 'perp' END AS market,
  event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, value AS price, value * 1200 AS start_usd, value * 1000 AS current_usd, event_id % 3 AS state,
  epoch_ms(date_trunc('hour', ts)) AS start_time, epoch_us(ts) // 1000 AS current_time, event_id FROM events WHERE value > 100)"""
COLS = ("id", "symbol", "exchange", "market", "side", "price", "current_usd", "state", "start_time", "current_time")
PICK = f"id, symbol, exchange, market, side, {q('price')} AS price, {q('current_usd')} AS current_usd, state::BIGINT AS state, start_time, current_time"


def raw_groups(w, row):
    """Venue groups as JSON text, one per symbol, book and hour."""
    inst = F.struct(c("exchange").alias("exName"), c("symbol").alias("baseAsset"), F.when(c("market") == "spot", "SPOT").alias("contractType"))
    g = w.groupBy("symbol", "exchange", "market", "start_time").agg(F.collect_list(row).alias("list"))
    return g.select("symbol", F.to_json(F.array(F.struct(inst.alias("instrument"), c("list")))).alias("json"))


@query("src_walls_flatten", f"WITH {WL} SELECT {PICK} FROM wl")
def _(spark, d):
    code = F.when(c("side") == "sell", 1).otherwise(2)
    row = F.struct("id", code.alias("side"), "price", c("start_usd").alias("startUsd"), c("current_usd").alias("currentUsd"), "state", c("start_time").alias("startTime"), c("current_time").alias("currentTime"))
    return tidy(W.flatten_walls(raw_groups(flows.walls(spark, d), row)), *COLS)


@query("src_trades_flatten", f"WITH {WL} SELECT id, symbol, exchange, market, side, {q('price')} AS price, {q('current_usd')} AS usd, current_time AS time_ms FROM wl")
def _(spark, d):
    w = flows.walls(spark, d)
    twice = w.unionByName(w)
    code = F.when(c("side") == "sell", 1).otherwise(2)
    row = F.struct("id", code.alias("side"), "price", c("current_usd").alias("volUsd"), F.lit(0).alias("turnoverTime"), c("current_time").alias("createTime"))
    return tidy(W.flatten_trades(raw_groups(twice, row)), "id", "symbol", "exchange", "market", "side", "price", "usd", "time_ms")


@query("pred_venue_market", f"WITH {WL} SELECT {PICK} FROM wl WHERE exchange = 'Binance' AND market = 'perp' AND state = 2")
def _(spark, d):
    return tidy(W.of_venue(flows.walls(spark, d), "binance", "perp", "revoked"), *COLS)


LASTP = "lp AS (SELECT symbol, close AS last_price FROM b WHERE rn = n)"


def last_price(spark, d):
    return bars(spark, d, "hourly").filter("rn = n").select("symbol", c("close").alias("last_price"))


@query("pred_book_threshold", over(f", {WL} SELECT {PICK} FROM wl WHERE current_usd >= CASE WHEN market = 'spot' THEN 110000 ELSE 140000 END AND abs(price - 150) / 150 <= 0.35", "hourly"))
def _(spark, d):
    w = flows.walls(spark, d).withColumn("now", F.lit(150.0))
    return tidy(W.above_threshold(w, 140000, 110000, "now"), *COLS)


@query("walls_age", f"""WITH {WL}, nw AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)
SELECT id, CASE WHEN state IN (2, 3) THEN greatest(0, floor((current_time - start_time) / 1000.0))::BIGINT ELSE greatest(0, floor((now - start_time) / 1000.0))::BIGINT END AS age FROM wl, nw WHERE NOT (state IN (2, 3) AND current_time <= start_time)""")
def _(spark, d):
    ticks = flows.event_ticks(spark, d)
    now = ticks.agg(F.max(F.unix_millis("ts")).alias("now"))
    return flows.walls(spark, d).join(F.broadcast(now)).select("id", W.wall_age("now").alias("age"))


DUPES = """du AS (SELECT *, event_id AS seq FROM wl UNION ALL SELECT * REPLACE (id || 'x' AS id), event_id + 1000000000 FROM wl UNION ALL SELECT * REPLACE (price + 1 AS price), event_id + 2000000000 FROM wl)"""


@query("walls_dedupe", f"""WITH {WL}, {DUPES}, d1 AS (SELECT * FROM du QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY exchange, market, side, price, start_time ORDER BY seq) = 1) SELECT {PICK} FROM d2""")
def _(spark, d):
    w = flows.walls(spark, d).withColumn("seq", c("event_id"))
    more = w.withColumns({"id": F.concat("id", F.lit("x")), "seq": c("seq") + 1000000000})
    other = w.withColumns({"price": c("price") + 1, "seq": c("seq") + 2000000000})
    return tidy(W.dedupe_walls(w.unionByName(more).unionByName(other)), *COLS)


@query("walls_balanced_topn", f"""WITH {WL}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY current_usd DESC, id) AS place FROM wl), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END, current_usd DESC, id) AS place FROM wl)
SELECT 'size' AS mode, id, symbol, side, place FROM s WHERE place <= 8 UNION ALL SELECT 'near', id, symbol, side, place FROM p WHERE place <= 8""")
def _(spark, d):
    w = flows.walls(spark, d)
    by_size = W.balanced_top(w, 15).withColumn("mode", F.lit("size"))
    near = W.balanced_top(w, 15, "price").withColumn("mode", F.lit("near"))
    return tidy(by_size.unionByName(near), "mode", "id", "symbol", "side", "place")


SWEPT = """sw AS (SELECT wl.*, coalesce(bool_or(CASE WHEN side = 'sell' THEN b.high > price * 1.0005 ELSE b.low < price * 0.9995 END), false) AS swept
  FROM wl LEFT JOIN b ON b.symbol = wl.symbol AND epoch_ms(b.time) >= current_time GROUP BY ALL)"""


@query("range_wall_swept", over(f", {WL}, {SWEPT} SELECT id, symbol, side, swept FROM sw", "hourly"))
def _(spark, d):
    return W.swept_walls(flows.walls(spark, d), bars(spark, d, "hourly")).select("id", "symbol", "side", "swept")


@query("walls_live", over(f", {WL}, {SWEPT}, {LASTP} SELECT {PICK} FROM sw JOIN lp USING (symbol) WHERE NOT swept AND NOT CASE WHEN side = 'sell' THEN price < last_price ELSE price > last_price END", "hourly"))
def _(spark, d):
    return tidy(W.live_walls(flows.walls(spark, d), bars(spark, d, "hourly"), last_price(spark, d)), *COLS)


@query("agg_wall_stats", f"""WITH {WL} SELECT exchange, market, {q("sum(CASE WHEN side = 'buy' THEN current_usd ELSE 0 END)", 2)} AS bids_usd, {q("sum(CASE WHEN side = 'sell' THEN current_usd ELSE 0 END)", 2)} AS asks_usd, count(*) AS walls FROM wl GROUP BY ALL""")
def _(spark, d):
    return tidy(W.wall_stats(flows.walls(spark, d)), "exchange", "market", "bids_usd", "asks_usd", "walls", digits=2)
