"""Large resting orders: flattening, filters, de-duplication, selection and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c

VENUE = "struct<exName:string,baseAsset:string,contractType:string,type:string,instrumentId:string>"
WALL_GROUPS = (
    f"array<struct<instrument:{VENUE},list:array<struct<id:string,side:int,price:double,startUsd:double,currentUsd:double,"
    "startAmount:double,currentAmount:double,volUsd:double,state:int,startTime:bigint,currentTime:bigint>>>>"
)
TRADE_GROUPS = (
    f"array<struct<instrument:{VENUE},list:array<struct<id:string,side:int,price:double,volUsd:double,baseVol:double,"
    "turnoverTime:bigint,createTime:bigint,exchangeName:string>>>>"
)
CROSS_SLACK = 0.0
SWEEP_SLACK = 0.0005
SNAPSHOT_WINDOW_MS = 45000


def market_of(instrument: str = "g.instrument") -> Column:
    spot = (c(f"{instrument}.type") == "10") | (F.upper(c(f"{instrument}.contractType")) == "SPOT")
    return F.when(F.coalesce(spot, F.lit(False)), "spot").otherwise("perp")


def side_of(code: str) -> Column:
    return F.when(c(code) == 1, "sell").when(c(code) == 2, "buy")


def _or_zero(x, kind="double") -> Column:
    return F.coalesce(c(x), F.lit(0)).cast(kind)


def _exploded(raw: DataFrame, column: str, schema: str, keep) -> DataFrame:
    return (
        raw.select(*keep, F.explode(F.from_json(c(column), schema)).alias("g"))
        .select(*keep, "g", F.posexplode("g.list").alias("seq", "o"))
        .withColumns({"exchange": F.coalesce(c("g.instrument.exName"), F.lit("")), "market": market_of()})
    )


def flatten_walls(raw: DataFrame, column="json", keep=("symbol",)) -> DataFrame:
    """Wall rows from venue groups as JSON text; rows without side or positive price are dropped."""
    df = _exploded(raw, column, WALL_GROUPS, keep).withColumn("side", side_of("o.side"))
    df = df.filter(c("side").isNotNull() & (c("o.price") > 0))
    started = _or_zero("o.startTime", "long")
    fallback = F.concat_ws(":", "exchange", "market", "side", c("o.price").cast("string"), started.cast("string"))
    return df.select(
        *keep, F.coalesce(c("o.id"), fallback).alias("id"), "exchange", c("g.instrument.baseAsset").alias("base"), "market",
        c("g.instrument.instrumentId").alias("instrument_id"), "side", c("o.price").alias("price"),
        _or_zero("o.startUsd").alias("start_usd"), _or_zero("o.currentUsd").alias("current_usd"),
        _or_zero("o.startAmount").alias("start_amount"), _or_zero("o.currentAmount").alias("current_amount"),
        _or_zero("o.volUsd").alias("vol_usd"), _or_zero("o.state", "int").alias("state"),
        started.alias("start_time"), _or_zero("o.currentTime", "long").alias("current_time"), "seq",
    )


def flatten_trades(raw: DataFrame, column="json", keep=("symbol",)) -> DataFrame:
    """Executed large trades, one row per (exchange, market, id)."""
    df = _exploded(raw, column, TRADE_GROUPS, keep).withColumn("side", side_of("o.side"))
    time = F.coalesce(F.nullif(c("o.turnoverTime"), F.lit(0)), c("o.createTime"))
    df = df.withColumns({"time_ms": time, "exchange": F.coalesce(c("g.instrument.exName"), c("o.exchangeName"), F.lit(""))})
    good = c("side").isNotNull() & (c("o.price") > 0) & (c("o.volUsd") > 0) & (c("time_ms") > 0)
    made = F.concat_ws(":", "exchange", "market", "side", c("o.price").cast("string"), c("time_ms").cast("string"))
    rows = df.filter(good).select(
        *keep, F.coalesce(c("o.id"), made).alias("id"), "exchange", "market", "side", c("o.price").alias("price"),
        c("o.volUsd").alias("usd"), _or_zero("o.baseVol").alias("amount"), "time_ms", "seq",
    )
    fields = [x for x in rows.columns if x not in ("exchange", "market", "id")]
    first = F.min_by(F.struct(*fields), F.struct("time_ms", "seq"))
    return rows.groupBy("exchange", "market", "id").agg(first.alias("f")).select("exchange", "market", "id", *[f"f.{x}" for x in fields if x != "seq"])


def dedupe_walls(walls: DataFrame, order="seq") -> DataFrame:
    """First wall per id, and first per (venue, market, side, price, start)."""
    alike = ("exchange", "market", "side", "price", "start_time")
    fields = [x for x in walls.columns if x != "id"]
    first = walls.groupBy("id").agg(F.min_by(F.struct(*fields), order).alias("w")).select("id", "w.*")
    rest = [x for x in first.columns if x not in alike]
    return first.groupBy(*alike).agg(F.min_by(F.struct(*rest), order).alias("w")).select(*alike, "w.*").select(*walls.columns)


def of_venue(walls: DataFrame, venue=None, market=None, status="active") -> DataFrame:
    out = walls
    if venue:
        out = out.filter(F.lower("exchange") == venue.lower())
    if market in ("spot", "perp"):
        out = out.filter(c("market") == market)
    if status in ("active", "revoked"):
        out = out.filter(c("state") == (1 if status == "active" else 2))
    return out


def above_threshold(walls: DataFrame, min_usd: float, spot_min_usd=None, price=None, max_distance=0.35) -> DataFrame:
    """Per-book minimum size, and closeness to the current price when one is given."""
    least = F.when(c("market") == "spot", float(min_usd if spot_min_usd is None else spot_min_usd)).otherwise(float(min_usd))
    out = walls.filter(c("current_usd") >= least)
    if price is not None:
        now = c(price)
        out = out.filter(~(now > 0) | (F.abs(c("price") - now) / F.nullif(now, F.lit(0.0)) <= max_distance))
    return out


def balanced_top(walls: DataFrame, top: int, price=None, keys=("symbol",)) -> DataFrame:
    """ceil(top / 2) walls per side: nearest the market when a price is known, else largest."""
    half = -(-top // 2)
    nearness = F.when(c("side") == "buy", -c("price")).otherwise(c("price"))
    size = c("current_usd").desc()
    order = [size, "id"] if price is None else [nearness, size, "id"]
    w = Window.partitionBy(*keys, "side").orderBy(*order)
    return walls.withColumn("place", F.row_number().over(w)).filter(c("place") <= half)


def epoch_ms(x) -> Column:
    """Seconds or milliseconds to milliseconds; missing is zero."""
    v = F.coalesce(c(x), F.lit(0))
    return F.when(v <= 0, 0).when(v < 100000000000, v * 1000).otherwise(v).cast("long")


def wall_age(now_ms) -> Column:
    """Seconds a wall has rested; revoked walls end at their last change."""
    start, seen, now = epoch_ms("start_time"), epoch_ms("current_time"), c(now_ms)
    ended = F.when(c("state").isin(2, 3), F.when(seen > start, seen).otherwise(now)).otherwise(F.greatest(now, seen))
    return F.when(start > 0, F.greatest(F.lit(0), F.floor((ended - start) / 1000)))


def crossed(price, slack=CROSS_SLACK) -> Column:
    p = c(price)
    hit = F.when(c("side") == "sell", c("price") < p * (1 - slack)).when(c("side") == "buy", c("price") > p * (1 + slack))
    return F.coalesce(hit & (p > 0), F.lit(False))


def later_extremes(bars: DataFrame, width_seconds: int) -> DataFrame:
    """Highest high and lowest low from each bar to the end of its key.

    A reversed running extreme: blocks are scanned alone and joined with what later blocks hold.
    """
    from barloom.plans.blocks import KEYS, running

    turned = bars.withColumn("rn", c("n") - c("rn") + 1)
    out = running(turned, {"high_after": ("max", "high"), "low_after": ("min", "low")})
    return out.select(*KEYS, "time", "high_after", "low_after")


def swept_walls(walls: DataFrame, bars: DataFrame, snapshot_ms=None, slack=SWEEP_SLACK) -> DataFrame:
    """Walls some later bar traded through, found from suffix extremes instead of wall x bar pairs.

    A wall is swept when any bar opening at or after it was last seen reaches beyond its price, so
    the extreme over all those bars decides.
    """
    from barloom.plans.asof import asof_join

    ends = later_extremes(bars, 3600)
    seen = epoch_ms("current_time")
    if snapshot_ms is not None:
        seen = F.greatest(seen, epoch_ms(snapshot_ms) - SNAPSHOT_WINDOW_MS)
    left = walls.withColumn("_seen", F.timestamp_millis(seen))
    got = asof_join(left, ends, ("symbol",), "_seen", "time", {"high_after": "high_after", "low_after": "low_after"}, forward=True)
    swept = F.when(c("side") == "sell", c("high_after") > c("price") * (1 + slack)).when(c("side") == "buy", c("low_after") < c("price") * (1 - slack))
    return got.withColumn("swept", F.coalesce(swept, F.lit(False))).drop("_seen", "matched_time")


def live_walls(walls: DataFrame, bars: DataFrame, last_price: DataFrame, slack=SWEEP_SLACK) -> DataFrame:
    """Walls neither on the wrong side of the last price nor swept since they were seen."""
    df = swept_walls(walls, bars, slack=slack).join(last_price, "symbol", "left")
    return df.filter(~c("swept") & ~crossed("last_price")).select(*walls.columns)


def wall_stats(walls: DataFrame) -> DataFrame:
    """Totals per venue and market."""
    bid, ask = c("side") == "buy", c("side") == "sell"
    part = lambda when, x: F.sum(F.when(when, c(x)).otherwise(0.0))
    return walls.groupBy("exchange", "market").agg(
        part(bid, "current_usd").alias("bids_usd"), part(ask, "current_usd").alias("asks_usd"),
        part(bid, "start_usd").alias("buy_volume_usd"), part(ask, "start_usd").alias("sell_volume_usd"),
        F.count(F.lit(1)).alias("walls"),
    )
