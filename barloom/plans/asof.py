"""As-of and nearest matches without range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import col

BUCKET_SECONDS = 86400


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys,
    left_time,
    right_time,
    values: dict,
    tolerance_seconds: float | None = None,
    forward: bool = False,
    prefer_first: bool = True,
    tie="_seq",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Attach to each left row the latest right row at or before it (at or after with ``forward``).

    ``values`` maps output names to right columns; ``matched_time`` is added. Both sides are stacked
    and read in time order inside buckets of time, so one busy key is spread over all its buckets.
    What a bucket leaves to later ones is its last right row: with a tolerance that row is copied to
    the few buckets it can reach, without one to all buckets up to the next right row.
    Right rows sharing one time are reduced to the first (or last) in ``tie`` order beforehand.
    """
    lt, rt = col(left_time), col(right_time)
    payload = F.struct(rt.alias("matched_time"), *[col(c).alias(n) for n, c in values.items()])
    order = F.col(tie) if tie in right.columns else F.lit(0)
    pick = F.min_by if prefer_first else F.max_by
    edge = F.min_by if forward else F.max_by
    step = -1 if forward else 1
    bucket = F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / int(bucket_seconds * 1e6)).alias("_b")
    r = right.select(*keys, rt.alias("_t"), payload.alias("_r"), order.alias("_o")).filter(F.col("_t").isNotNull())
    r = r.groupBy(*keys, "_t", bucket).agg(pick("_r", "_o").alias("_r"))
    l = left.select(*keys, lt.alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row")).select("*", bucket)
    both = l.unionByName(r, allowMissingColumns=True)
    when = F.col("_t") if not forward else F.col("_t").desc()
    # Right rows come first at equal times.
    inside = Window.partitionBy(*keys, "_b").orderBy(when, F.col("_r").isNull())
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    if tolerance_seconds is not None:
        reach = int(tolerance_seconds // bucket_seconds) + 1
        ends = r.groupBy(*keys, "_b").agg(edge("_r", "_t").alias("_r"), (F.min if forward else F.max)("_t").alias("_t"))
        copies = ends.withColumn("_b", F.explode(F.array(*[F.col("_b") + step * k for k in range(1, reach + 1)])))
        both = both.unionByName(copies, allowMissingColumns=True)
        found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(inside)).filter("_row is not null")
        gap = F.abs(F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_m.matched_time").cast("timestamp")))
        found = found.withColumn("_m", F.when(gap <= int(tolerance_seconds * 1e6), F.col("_m")))
    else:
        # Every bucket up to the next one with right rows gets the end before it; what follows the
        # last right bucket of a key is looked up in one row per key.
        nearest_first = Window.partitionBy(*keys).orderBy(F.col("_b") * step)
        ends = r.groupBy(*keys, "_b").agg(edge("_r", "_t").alias("_r"), (F.min if forward else F.max)("_t").alias("_t"))
        ends = ends.withColumn("_until", F.lead("_b").over(nearest_first))
        gaps = F.explode(F.sequence(F.col("_b") + step, F.col("_until"), F.lit(step)))
        copies = ends.filter("_until is not null").withColumn("_b", gaps).drop("_until")
        final = ends.filter("_until is null").select(*keys, F.col("_b").alias("_fb"), F.col("_r").alias("_fr"))
        both = both.unionByName(copies, allowMissingColumns=True)
        found = both.withColumn("_near", F.last("_r", ignorenulls=True).over(inside)).filter("_row is not null")
        past = (F.col("_b") - F.col("_fb")) * step > 0
        found = found.join(final, list(keys), "left").withColumn("_m", F.coalesce("_near", F.when(past, F.col("_fr"))))
    return found.select("_row.*", "_m.matched_time", *[f"_m.{n}" for n in values])


def asof_probes(left: DataFrame, probes: dict, keys, time: str, slack_seconds: float, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Several as-of matches of each left row in one shuffle and one sort.

    ``probes`` maps a prefix to (right table, its time, seconds back, values): the latest right row at or before
    ``time`` minus the seconds and at most ``slack_seconds`` older, its columns and ``time`` named with the prefix. Right rows are
    moved forward by their seconds and stacked with the left rows, so that one window per bucket of time answers all
    probes; a row that reaches into the next bucket within the slack is copied there beforehand. Of right rows
    with one time, the one that sorts highest by its values is taken.
    """
    slack = int(slack_seconds * 1e6)
    bucket = lambda us: F.floor(us / int(bucket_seconds * 1e6))
    us = F.unix_micros(F.col(time).cast("timestamp"))
    stacked = left.select(*keys, us.alias("_t"), F.array(bucket(us)).alias("_bs"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    for prefix, (right, right_time, seconds, values) in probes.items():
        moved = F.unix_micros(F.col(right_time).cast("timestamp")) + int(seconds * 1e6)
        payload = F.struct(*[F.col(v).alias(f"{prefix}{v}") for v in values], F.col(right_time).alias(f"{prefix}time"))
        copies = right.filter(F.col(right_time).isNotNull()).select(*keys, moved.alias("_t"), F.array_distinct(F.array(bucket(moved), bucket(moved + slack))).alias("_bs"), payload.alias(f"_{prefix}"))
        stacked = stacked.unionByName(copies, allowMissingColumns=True)
    stacked = stacked.withColumn("_b", F.explode("_bs")).drop("_bs")
    # right rows come first at equal times
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_row").isNotNull(), *[f"_{p}" for p in probes]).rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_m{p}": F.last(F.when(F.col(f"_{p}").isNotNull(), F.struct("_t", f"_{p}")), ignorenulls=True).over(inside) for p in probes}
    found = stacked.withColumns(last).filter("_row is not null")
    near = lambda p, name: F.when(F.col("_t") - F.col(f"_m{p}._t") <= slack, F.col(f"_m{p}._{p}.{name}")).alias(name)
    return found.select("_row.*", *[near(p, f"{p}{v}") for p, (_, _, _, values) in probes.items() for v in ("time", *values)])


def nearest_join(left, right, keys, left_time, right_time, values: dict, tolerance_seconds: float, **kw) -> DataFrame:
    """Nearest right row within the tolerance; the earlier one wins a tie."""
    back = asof_join(left, right, keys, left_time, right_time, values, tolerance_seconds, **kw)
    back = back.withColumnsRenamed({"matched_time": "_bt", **{n: f"_b_{n}" for n in values}})
    both = asof_join(back, right, keys, left_time, right_time, values, tolerance_seconds, forward=True, **kw)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lt = F.unix_micros(col(left_time).cast("timestamp"))
    earlier = F.col("_bt").isNotNull() & (F.col("matched_time").isNull() | (lt - us("_bt") <= us("matched_time") - lt))
    pick = lambda a, b: F.when(earlier, F.col(a)).otherwise(F.col(b))
    return both.select(
        *left.columns,
        pick("_bt", "matched_time").alias("matched_time"),
        *[pick(f"_b_{n}", n).alias(n) for n in values],
    )
