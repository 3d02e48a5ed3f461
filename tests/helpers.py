"""Small candle series with known shapes."""

import math

from pyspark.sql import functions as F

from barloom.plans.blocks import number_rows

SCHEMA = "symbol string, timeframe string, time timestamp, open double, high double, low double, close double, volume double"


def lcg_closes(n, seed=42):
    x, price, out = seed, 100.0, []
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        price *= 1 + (x / 2**31 - 0.5) * 0.04
        out.append(price)
    return out


def candles(spark, closes, symbol="AAA", timeframe="1h", spread=0.004):
    from datetime import datetime, timedelta

    start, rows, before = datetime(2024, 1, 1), [], closes[0]
    for i, c in enumerate(closes):
        wick = abs(c) * spread * (1 + math.sin(i) ** 2)
        rows.append((symbol, timeframe, start + timedelta(hours=i), before, max(before, c) + wick, min(before, c) - wick, c, 100.0 + 40 * math.cos(i * 0.7)))
        before = c
    return spark.createDataFrame(rows, SCHEMA)


def numbered(spark, closes, **kw):
    return number_rows(candles(spark, closes, **kw))


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("rn").select(*[F.col(x) for x in columns]).collect()]


def close_to(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b
