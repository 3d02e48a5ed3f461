"""First later row at or below a level, for many points at once.

Rows of a key are summarised in a tree of ``FAN`` children a node, each with its smallest value. A point climbs
from its own row until a later sibling reaches its level and then descends to the row. Every step is an equi join on
(key, node), so a long key is spread over all its nodes, and no point is ever compared with all later rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import KEYS
from barloom.session import cut_lineage

#: Three levels of this width hold a thousand million rows a key.
FAN, LEVELS = 1024, 3


def first_at_or_below(points: DataFrame, rows: DataFrame, value, level: str, after: str, name: str, strict=False, keys=KEYS) -> DataFrame:
    """``points`` with column ``name``: the first rn > ``after`` where ``value`` of ``rows`` is at or below ``level``.

    With ``strict`` the value must be below the level. Null where no later row gets there, or the level is null.
    """
    keys = list(keys)
    values = rows.select(*keys, (F.col("rn") - 1).alias("_at"), (value if isinstance(value, Column) else F.col(value)).alias("_v"))
    trees = []
    for _ in range(LEVELS):
        node = values.withColumn("_node", F.floor(F.col("_at") / FAN))
        tree = node.groupBy(*keys, "_node").agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_kids"), F.min("_v").alias("_low"))
        tree = cut_lineage(tree)
        trees.append(tree.select(*keys, "_node", "_kids"))
        values = tree.select(*keys, F.col("_node").alias("_at"), F.col("_low").alias("_v"))

    def reaches(kid):
        return kid["_v"] < F.col(level) if strict else kid["_v"] <= F.col(level)

    def child(df, tree, node: Column, beyond: Column):
        """The first child of ``node`` after ``beyond`` that reaches the level."""
        at = df.withColumn("_node", node).join(tree, [*keys, "_node"], "left")
        fit = F.filter("_kids", lambda kid: (kid["_at"] > beyond) & reaches(kid))
        return at.withColumn("_hit", F.get(fit, F.lit(0))["_at"]).drop("_kids", "_node")

    # places count from zero, so ``after`` - 1 is the last place passed
    state = points.withColumns({"_from": F.col(after) - 1, "_found": F.lit(None).cast("long"), "_height": F.lit(None).cast("int")})
    for height in range(LEVELS):
        passed = F.floor(F.col("_from") / FAN**height)
        state = child(state, trees[height], F.when(F.col("_found").isNull(), F.floor(passed / FAN)), passed)
        new = F.col("_found").isNull() & F.col("_hit").isNotNull()
        state = state.withColumns({"_height": F.when(new, height).otherwise(F.col("_height")), "_found": F.coalesce("_found", "_hit")}).drop("_hit")
    for height in range(LEVELS - 2, -1, -1):
        down = F.col("_height") > height
        state = child(state, trees[height], F.when(down, F.col("_found")), F.lit(-1)).withColumn("_found", F.when(down, F.col("_hit")).otherwise(F.col("_found"))).drop("_hit")
    return state.withColumn(name, F.col("_found") + 1).drop("_from", "_found", "_height")
