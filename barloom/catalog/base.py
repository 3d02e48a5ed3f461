"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.bars import numbered_bars

QUERIES: dict = {}
ORACLES: dict = {}

# Both sides add this before rounding, so that exact decimal ties fall the same way.
NUDGE = 3.7e-7


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def r(c, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + NUDGE, digits) + F.lit(0.0)


def q(expr: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    return f"(round(({expr}) + {NUDGE}, {digits}) + 0.0)"


def tidy(df: DataFrame, *columns, digits: int = 4) -> DataFrame:
    """Select columns for output: doubles rounded, timestamps without zone, integers as bigint."""
    out = []
    for name in columns or df.columns:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.DoubleType):
            c = r(c, digits)
        elif isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def bars(spark, folder, name="brand") -> DataFrame:
    return numbered_bars(spark, folder, name)


# ---- the candle adapters as SQL -----------------------------------------------------------

_FINISH = """
b AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS rn, count(*) OVER (PARTITION BY symbol) AS n
  FROM bars)"""

LINE_TICKS = """
ticks AS (
  SELECT p_brand AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
         l_returnflag, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_BARS = """
bars AS (
  SELECT symbol, '{tf}' AS timeframe, {bucket} AS time, arg_min(price, seq) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, seq) AS close, sum(quantity) AS volume
  FROM ticks GROUP BY symbol, {bucket})"""

EVENT_TICKS = """
ticks AS (SELECT event_type AS symbol, ts, value AS price, value AS quantity, row(ts, event_id) AS seq,
                 event_id, user_id FROM events)"""

ORDER_TICKS = """
ticks AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS price, 1.0 AS quantity,
                 row(o_orderdate, o_orderkey) AS seq FROM orders)"""


def _with(ticks: str, tf: str, bucket: str) -> str:
    return ticks + "," + _BARS.format(tf=tf, bucket=bucket) + "," + _FINISH


def floor_sql(seconds: int, ts: str = "ts") -> str:
    return f"make_timestamp((epoch_us({ts}) // {seconds * 1000000}) * {seconds * 1000000})"


BARS_SQL = {
    "brand": _with(LINE_TICKS, "1d", "date_trunc('day', ts)"),
    "hourly": _with(EVENT_TICKS, "1h", floor_sql(3600)),
    "quarter": _with(EVENT_TICKS, "15m", floor_sql(900)),
    "orders": _with(ORDER_TICKS, "1d", "date_trunc('day', ts)"),
}


def over(body: str, name: str = "brand", recursive: bool = False) -> str:
    """A query over the adapter's CTEs; ``b`` holds numbered candles."""
    return f"WITH {'RECURSIVE' if recursive else ''} {BARS_SQL[name]}{body if body.lstrip().startswith(',') else ' ' + body}"


def scan_sql(name: str, source: str, outputs: dict) -> str:
    """A recursive CTE solving y = rate * y + b row by row; outputs maps y to (rate, b column)."""
    first = ", ".join(f"s.{b} AS {y}" for y, (_, b) in outputs.items())
    step = ", ".join(f"{rate!r} * p.{y} + s.{b}" for y, (rate, b) in outputs.items())
    return f"""
{name} AS (
  SELECT s.symbol, s.rn, {first} FROM {source} s WHERE s.rn = 1
  UNION ALL
  SELECT s.symbol, s.rn, {step} FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""
