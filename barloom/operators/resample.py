"""Coarser candles from finer ones, and the choice of which candles count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.blocks import KEYS, frame, number_rows

c = F.col


def utc_floor(seconds: int, time="time") -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / seconds) * seconds)


def calendar_bucket(unit: str, time="time") -> Column:
    """Start of the UTC day (D), Monday week (W), month (M), or n-minute slot."""
    words = {"D": "day", "W": "week", "M": "month"}
    if unit in words:
        return F.date_trunc(words[unit], time)
    return utc_floor(int(unit) * 60, time)


def group_bars(bars: DataFrame, bucket: Column, keys=KEYS) -> DataFrame:
    """First open, highest high, lowest low, last close per bucket, one shuffle with partial merges."""
    return bars.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("volume").alias("volume"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("bars"),
    )


def chart_seconds(bars: DataFrame, block=None) -> DataFrame:
    """Smallest positive gap between neighbouring bars per key, 60 s when there is none."""
    f = frame(bars, 1, block=block)
    gap = F.unix_micros("time") - F.unix_micros(f.lag("time"))
    gaps = f.add(gap=F.when(gap > 0, gap / 1e6)).rows()
    return gaps.groupBy(*KEYS).agg(F.coalesce(F.min("gap"), F.lit(60.0)).alias("period_seconds"))


def resample_htf(bars: DataFrame, seconds: int, chart_sec: int) -> DataFrame:
    """UTC-floor buckets already closed when the key's last bar closes."""
    grouped = group_bars(bars, utc_floor(seconds))
    end = bars.groupBy(*KEYS).agg(F.max("time").alias("_end"))
    closes = F.unix_seconds("bucket") + seconds
    return (
        grouped.join(end, list(KEYS))
        .filter(closes <= F.unix_seconds("_end") + chart_sec)
        .withColumn("close_time", F.timestamp_seconds(closes))
        .drop("_end")
    )


def resample_calendar(bars: DataFrame, unit: str) -> DataFrame:
    """Calendar buckets; a key's newest one is still forming."""
    grouped = group_bars(bars, calendar_bucket(unit))
    newest = grouped.groupBy(*KEYS).agg(F.max("bucket").alias("_newest"))
    return grouped.join(newest, list(KEYS)).withColumn("forming", c("bucket") == c("_newest")).drop("_newest")


def resample_gap_aware(bars: DataFrame, seconds: int, source_seconds: int) -> DataFrame:
    """Buckets with the bar that proves each one closed.

    A bucket whose last source bar reaches its end is confirmed there, one that ends in a gap only
    at the next observed bar; a last bucket that is not full is left out.
    """
    grouped = group_bars(bars, utc_floor(seconds))
    # Buckets are numbered like bars so that the next one is found inside a block.
    numbered = number_rows(grouped, order=("bucket",), chunk=F.floor(F.unix_seconds("bucket") / (seconds * 4096)))
    f = frame(numbered, lookahead=1)
    full = F.unix_seconds("last_time") + source_seconds >= F.unix_seconds("bucket") + seconds
    f = f.add(confirm_time=F.when(full, c("last_time")).otherwise(f.lead("first_time")))
    return f.rows().filter("confirm_time is not null").drop("rn", "n")


def resample_count(bars: DataFrame, size: int) -> DataFrame:
    """Buckets of ``size`` bars from the first one; an incomplete last bucket is dropped."""
    grouped = group_bars(bars, F.floor((c("rn") - 1) / size))
    return grouped.filter(c("bars") == size).withColumn("end_rn", (c("bucket") + 1) * size)


def range_limit(bars: DataFrame, start=None, end=None, limit=None) -> DataFrame:
    """Bars opening inside [start, end], then the last ``limit`` of them, renumbered.

    The cut by count keeps at most ``limit`` rows per key and task before any shuffle.
    """
    out = bars
    if start is not None:
        out = out.filter(c("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(c("time") <= F.lit(end).cast("timestamp"))
    base = bars.columns
    if limit is not None and "rn" in base:
        # Positions are known: the highest one left tells where the tail starts.
        top = out.groupBy(*KEYS).agg(F.max("rn").alias("_top"), F.min("rn").alias("_low"))
        out = out.join(top, list(KEYS)).filter(c("rn") > c("_top") - limit)
        first = F.greatest(c("_low"), c("_top") - limit + 1)
        return out.withColumns({"rn": c("rn") - first + 1, "n": c("_top") - first + 1}).select(*base)
    if limit is not None:
        newest = Window.partitionBy(*KEYS).orderBy(c("time").desc())
        out = out.withColumn("_k", F.row_number().over(newest)).filter(c("_k") <= limit).drop("_k")
    return out
