"""Ranges of rows as few nodes of a tree over positions, and what follows from that.

A node of level k holds ``FAN``^k neighbouring rows. A range of rows is a union of a few nodes a level, the row's path is
one node a level, and a row lies in a range exactly if one of its path's nodes is among the range's. So
questions about long ranges become equi joins and windows on (key, level, node): no row meets all ranges, no range
meets all its rows, and a hot key is spread over its nodes. Above the top level a range takes all its top nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.blocks import KEYS

#: Seven levels reach nodes of 262,144 rows.
FAN, LEVELS = 8, 7


def path(rn) -> Column:
    """(level, node) of every node that holds row ``rn``."""
    at = (F.col(rn) if isinstance(rn, str) else rn) - 1
    return F.array(*(F.struct(F.lit(k).alias("level"), F.floor(at / FAN**k).cast("long").alias("node")) for k in range(LEVELS)))


def cover(first, last) -> Column:
    """(level, node) of the nodes whose rows are exactly those from ``first`` to ``last``; none where last < first."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    begin, end = (col(first) - 1).cast("long"), F.greatest(col(last), col(first) - 1).cast("long")
    bits = FAN.bit_length() - 1
    lo = [F.shiftright(begin + (FAN**k - 1), bits * k) for k in range(LEVELS)]  # whole nodes from here
    hi = [F.shiftright(end, bits * k) for k in range(LEVELS)]  # up to here
    span = lambda a, b, k: F.when(b > a, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(k).alias("level"), x.alias("node"))))
    parts = []
    for k in range(LEVELS - 1):
        # where no whole node of the next level lies inside, all that is left is taken here
        whole = lo[k + 1] < hi[k + 1]
        parts += [span(lo[k], F.when(whole, lo[k + 1] * FAN).otherwise(hi[k]), k), F.when(whole, span(hi[k + 1] * FAN, hi[k], k))]
    parts.append(span(lo[-1], hi[-1], LEVELS - 1))
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    return F.concat(*(F.coalesce(p, none) for p in parts))


def count_rises(ranges: DataFrame, rows: DataFrame, value, level: str, first, last, name: str, keys=KEYS) -> DataFrame:
    """``ranges`` with ``name``: how many rows from ``first`` to ``last`` rise to the level.

    A row rises to a level if its ``value`` is at or above it and the row's before is below it; ``rows`` carry both as
    ``value`` (now, before). A rise is a band of prices (before, now], so the count is that of bands over the level: in
    each node, the bands' lower ends below the level less their upper ends below it, both read off one running
    sum over the node's ends and levels in price order.
    """
    keys = list(keys)
    now, before = value
    ends = F.array(F.struct(before.alias("v"), F.lit(1).alias("w")), F.struct(now.alias("v"), F.lit(-1).alias("w")))
    points = rows.filter(now > before).select(*keys, "rn", F.explode(ends).alias("e"))
    points = points.select(*keys, F.explode(path("rn")).alias("p"), "e.*", F.lit(None).cast("long").alias("_id"))
    ids = ranges.withColumn("_id", F.monotonically_increasing_id())
    asked = ids.select(*keys, "_id", F.col(level).alias("v"), F.explode(cover(first, last)).alias("p"))
    asked = asked.select(*keys, "p", "v", F.lit(0).alias("w"), "_id")
    # a level comes before the ends equal to it: only ends below it count
    in_order = Window.partitionBy(*keys, "_level", "_node").orderBy("v", F.col("_id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(asked).select(*keys, F.col("p.level").alias("_level"), F.col("p.node").alias("_node"), "v", "w", "_id")
    counted = both.withColumn("_n", F.sum("w").over(in_order)).filter("_id is not null").groupBy("_id").agg(F.sum("_n").alias(name))
    return ids.join(counted, "_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).drop("_id")


def newest_over(rows: DataFrame, ranges: DataFrame, first, last, picks: dict, keys=KEYS) -> DataFrame:
    """``rows`` with one column a pick: over the ranges that hold the row, the largest value (null where none does).

    ``picks`` maps a name to a column of ``ranges``, null where a range is no candidate; structs compare field by field.
    Ranges leave their largest value at each of their nodes, a row takes the largest along its path.
    """
    keys = list(keys)
    nodes = ranges.select(*keys, F.explode(cover(first, last)).alias("p"), *(v.alias(k) for k, v in picks.items()))
    best = nodes.groupBy(*keys, F.col("p.level").alias("_level"), F.col("p.node").alias("_node")).agg(*(F.max(k).alias(k) for k in picks))
    on_path = rows.select(*keys, "rn", F.explode(path("rn")).alias("p")).select(*keys, "rn", F.col("p.level").alias("_level"), F.col("p.node").alias("_node"))
    got = on_path.join(best, [*keys, "_level", "_node"]).groupBy(*keys, "rn").agg(*(F.max(k).alias(k) for k in picks))
    return rows.join(got, [*keys, "rn"], "left")
