"""Candle tables made from ticks, and the adapters over the supplied tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.blocks import number_rows


def bars_from_ticks(ticks: DataFrame, timeframe: str, bucket, order, keys=("symbol",)) -> DataFrame:
    """Ticks (price, quantity) to candles; open and close follow the total ``order``.

    One shuffle; ticks are reduced per map task first, so a hot symbol sends one row per bar.
    """
    return (
        ticks.groupBy(*keys, bucket.alias("time"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"),
        )
        .select(*keys, F.lit(timeframe).alias("timeframe"), F.col("time").cast("timestamp").alias("time"),
                "open", "high", "low", "close", "volume")
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_ticks(spark, folder) -> DataFrame:
    """Order lines as ticks: price per unit, symbol from the part's brand."""
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return line.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
        "l_returnflag",
        "l_tax",
    )


def event_ticks(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.col("value").alias("quantity"),
        "event_id",
        "user_id",
    )


def brand_daily(spark, folder) -> DataFrame:
    return bars_from_ticks(line_ticks(spark, folder), "1d", F.date_trunc("day", "ts"), F.col("seq"))


def event_bars(spark, folder, timeframe="1h", seconds=3600) -> DataFrame:
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    return bars_from_ticks(event_ticks(spark, folder), timeframe, bucket, F.struct("ts", "event_id"))


def order_daily(spark, folder) -> DataFrame:
    ticks = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("quantity"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    return bars_from_ticks(ticks, "1d", F.date_trunc("day", "ts"), F.col("seq"))


ADAPTERS = {
    "brand": brand_daily,
    "hourly": event_bars,
    "quarter": lambda s, f: event_bars(s, f, "15m", 900),
    "orders": order_daily,
}
_held: dict = {}


def numbered_bars(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The adapter's candle table with ``rn`` and ``n``, held for the session.

    Candles are far fewer than ticks and feed many operators, so they are built once and kept
    (spilling to disk, rebuilt from the tables when an executor is lost).
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _held:
        bars = ADAPTERS[name](spark, folder).persist(StorageLevel.MEMORY_AND_DISK)
        numbered = number_rows(bars).persist(StorageLevel.MEMORY_AND_DISK)
        _held[key] = (bars, numbered)
    return _held[key][1]


def release_bars() -> None:
    for frames in _held.values():
        for df in frames:
            df.unpersist()
    _held.clear()
