"""Trade lists made from the candles by a fixed rule, with defects in three of four variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import KEYS

c = F.col
EVERY = 149
VARIANTS = ("open", "close", "copies", "wrong")


def rule_trades(bars: DataFrame) -> DataFrame:
    """Every 149th bar enters, alternately long and short, and leaves seven to eleven bars later."""
    entries = bars.filter((c("rn") % EVERY == 5) | (c("rn") % EVERY == 80)).withColumn("exit_rn", c("rn") + 7 + c("rn") % 5)
    exits = bars.select(*KEYS, c("rn").alias("exit_rn"), c("time").alias("xt"), c("close").alias("xc"))
    joined = entries.join(exits, [*KEYS, "exit_rn"])
    copies = F.when(c("variant") == "copies", F.sequence(F.lit(0), F.lit(19))).otherwise(F.array(F.lit(0)))
    df = joined.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))).withColumn("copy", F.explode(copies))
    price = F.when(c("variant") == "close", c("close")).when((c("variant") == "wrong") & (c("rn") % 2 == 0), c("high") * 3).otherwise(c("open"))
    later = lambda t, hours: F.timestamp_micros(F.unix_micros(t) + hours * 3600000000)
    return df.select(
        F.concat_ws("/", "symbol", "variant").alias("artifact_id"),
        (c("rn") * 32 + c("copy")).alias("trade_no"),
        *KEYS,
        later("time", 6).alias("entry_time"),
        later("xt", 18).alias("exit_time"),
        F.when(c("rn") % EVERY == 5, "long").otherwise("short").alias("side"),
        price.alias("entry_price"),
        c("xc").alias("exit_price"),
    )


def headers(trades: DataFrame) -> DataFrame:
    return trades.select("artifact_id", c("artifact_id").endswith("/close").alias("costs_included")).distinct()
