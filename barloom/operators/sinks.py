"""Writing candles, indicator tables and chart payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import half_up
from barloom.functions.exprs import col as c
from barloom.plans.blocks import KEYS

PAYLOAD_BARS = 200


def write_candle_csv(bars: DataFrame, root: str, files_per_key: int = 1) -> None:
    """``<root>/symbol=<symbol>/timeframe=<timeframe>/*.csv`` with the fixed header, committed by Spark's writer.

    A key goes to up to ``files_per_key`` files, so that a long one is not written by one task.
    """
    spread = F.pmod(F.hash("time"), F.lit(files_per_key))
    bars.repartition(*KEYS, spread).sortWithinPartitions(*KEYS, "time").write.partitionBy(*KEYS).option("header", True).csv(root)


def round_series(x, digits: int) -> Column:
    """Round once for output: non-finite becomes null and minus zero becomes zero."""
    v = c(x)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, half_up(F.when(ok, v), digits))


def csv_table(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    """One text line per bar: time, candle, then the columns with fixed digits, blank for null."""
    cell = lambda x: F.coalesce(F.call_function("format_number", c(x), F.lit("0." + "0" * digits)), F.lit(""))
    plain = [F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), *[c(x).cast("string") for x in ("open", "high", "low", "close", "volume")]]
    return df.select(*KEYS, "time", F.concat_ws(",", *plain, *[cell(x) for x in columns]).alias("line"))


def chart_payload(df: DataFrame, columns, cap: int = PAYLOAD_BARS) -> DataFrame:
    """The last ``cap`` bars of each key and aligned series as JSON; null when a candle is not finite."""
    tail = df.filter(c("rn") > c("n") - cap)
    ohlcv = ("open", "high", "low", "close", "volume")
    broken = F.lit(False)
    for x in ohlcv:
        broken = broken | c(x).isNull() | F.isnan(c(x)) | (F.abs(c(x)) == float("inf"))
    row = F.struct("rn", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), *ohlcv, *columns)
    # At most ``cap`` rows per key reach the list.
    g = tail.groupBy(*KEYS).agg(F.bool_or(broken).alias("bad"), F.sort_array(F.collect_list(row)).alias("l"))
    candle = lambda x: F.struct(*[x[k].alias(k) for k in ("time", *ohlcv)])
    series = F.struct(*[c(f"l.{k}").alias(k) for k in columns])
    payload = F.to_json(F.struct(F.transform("l", candle).alias("candles"), series.alias("series")), {"ignoreNullFields": "false"})
    return g.select(*KEYS, F.size("l").alias("bars"), F.when(~c("bad"), payload).alias("payload"))
