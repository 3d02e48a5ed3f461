"""Supply and demand zones: a tight base followed by a strong departure, and their later life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import range_stage, sma_stage
from barloom.plans.blocks import KEYS, frame
from barloom.plans.crossing import first_at_or_below
from barloom.plans.tree import count_rises
from barloom.session import cut_lineage

c = F.col
# Fixed values of the base and departure rules.
BASE_BARS = 6
DEPARTURE_BARS = 3
MIN_DISPLACEMENT = 1.5
BASE_BODY = 0.5
BASE_BAR_ATR = 0.8
BASE_RANGE_ATR = 1.0
IMPULSE_BODY_ATR = 0.8
IMPULSE_BODY = 0.6
EPS = 1e-12


def supply_demand_zones(bars, period=14, base_bars=BASE_BARS, departure=DEPARTURE_BARS, min_move=MIN_DISPLACEMENT, block=None) -> DataFrame:
    """Confirmed zones, overlapping ones of the same confirmation reduced to the longest base.

    The last bar of a key may be unclosed and is ignored.
    """
    f = range_stage(frame(bars, period + base_bars + 2, departure, block=block))
    f = sma_stage(f, period, "_atr", c("_tr"))
    span = c("high") - c("low")
    f = f.add(_span=span, _share=F.when(span > 0, F.abs(c("close") - c("open")) / F.nullif(span, F.lit(0.0))))
    bases = []
    for length in range(base_bars, 0, -1):
        w = f.last(length)
        atr = f.lag("_atr", length)
        high, low = F.max("high").over(w), F.min("low").over(w)
        ok = (
            (c("rn") - length >= period)
            & (atr > 0)
            & (F.min("_span").over(w) > 0)
            & (F.max("_span").over(w) / F.nullif(atr, F.lit(0.0)) <= BASE_BAR_ATR + EPS)
            & (F.max("_share").over(w) <= BASE_BODY + EPS)
            & ((high - low) / F.nullif(atr, F.lit(0.0)) <= BASE_RANGE_ATR + EPS)
        )
        top, bottom = F.greatest("open", "close"), F.least("open", "close")
        bases.append(
            F.when(
                ok,
                F.struct(
                    F.lit(length).alias("length"), low.alias("low"), high.alias("high"), atr.alias("atr"),
                    F.min(bottom).over(w).alias("body_low"), F.max(top).over(w).alias("body_high"),
                    f.lag("time", length - 1).alias("start_time"),
                ),
            )
        )
    f = f.add(_base=F.coalesce(*bases))
    steps = {}
    for j in range(1, departure + 1):
        steps[f"_next{j}"] = F.struct(
            *[f.lead(x, j).alias(x) for x in ("open", "high", "low", "close", "time")], (c("rn") + j).alias("rn")
        )
    f = f.add(**steps)
    df = f.rows("_base", *steps).filter("_base is not null")
    found = [_departure(kind, departure, min_move) for kind in ("supply", "demand")]
    df = df.withColumn("_z", F.explode(F.array_compact(F.array(*found))))
    zones = df.select(
        *KEYS, c("_z.kind").alias("kind"), c("_z.low").alias("low"), c("_z.high").alias("high"),
        (c("rn") - c("_base.length") + 1).alias("base_start"), c("rn").alias("base_end"),
        c("_base.start_time").alias("base_start_time"), c("time").alias("base_end_time"),
        c("_z.rn").alias("confirmed"), c("_z.time").alias("confirmed_time"),
        c("_base.atr").alias("atr"), c("_z.displacement").alias("displacement"),
    )
    return keep_longest(zones)


def _departure(kind: str, departure: int, min_move: float) -> Column:
    """The first following bar that completes a departure, unrolled over the few allowed bars."""
    supply = kind == "supply"
    sign = -1.0 if supply else 1.0
    atr = c("_base.atr")
    low = c("_base.body_low") if supply else c("_base.low")
    high = c("_base.high") if supply else c("_base.body_high")
    standing, impulse, options = F.lit(True), F.lit(False), []
    for j in range(1, departure + 1):
        b = c(f"_next{j}")
        usable = b["close"].isNotNull() & (b["rn"] < c("n"))
        opposite = b["close"] > c("_base.high") if supply else b["close"] < c("_base.low")
        standing = standing & usable & ~opposite
        body, span = sign * (b["close"] - b["open"]), b["high"] - b["low"]
        strong = (body / atr >= IMPULSE_BODY_ATR) & (span > 0) & (body / F.nullif(span, F.lit(0.0)) >= IMPULSE_BODY)
        impulse = impulse | F.coalesce(strong, F.lit(False))
        moved = (c("_base.low") - b["close"] if supply else b["close"] - c("_base.high")) / atr
        options.append(
            F.when(
                standing & impulse & (moved >= min_move),
                F.struct(
                    F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), b["rn"].alias("rn"),
                    b["time"].alias("time"), moved.alias("displacement"),
                ),
            )
        )
    first = F.coalesce(*options)
    return F.when(first["high"] > first["low"], first)


def keep_longest(zones: DataFrame) -> DataFrame:
    """Among zones confirmed by one bar, an overlapping later base replaces a shorter earlier one.

    A bar confirms at most one zone per base end within the departure window, so groups are tiny.
    """
    fields = [x for x in zones.columns if x not in (*KEYS, "kind", "confirmed")]
    z = F.struct("base_end", *[x for x in fields if x != "base_end"])
    grouped = zones.groupBy(*KEYS, "kind", "confirmed").agg(F.sort_array(F.collect_list(z)).alias("zs"))
    meets = lambda a, b: (a["base_start"] <= b["base_end"]) & (a["base_end"] >= b["base_start"])
    size = lambda a: a["base_end"] - a["base_start"]

    def place(kept, z):
        hit = F.get(F.filter(kept, lambda k: meets(k, z)), F.lit(0))
        swap = F.transform(kept, lambda k: F.when((k["base_end"] == hit["base_end"]) & (size(z) > size(k)), z).otherwise(k))
        return F.when(hit.isNull(), F.concat(kept, F.array(z))).otherwise(swap)

    kept = F.aggregate(F.slice("zs", F.lit(2), F.size("zs")), F.slice("zs", 1, 1), place)
    return grouped.withColumn("z", F.explode(kept)).select(*KEYS, "kind", "confirmed", *[f"z.{x}" for x in fields])


_ZONE = ("kind", "low", "high", "base_start", "base_end", "confirmed", "atr", "displacement")


def zone_lifecycle(bars, zones=None) -> DataFrame:
    """Each zone's status at the end: fresh, tested (separate visits), or invalidated by a close.

    No zone waits in a state. The first close beyond a zone comes from the tree of block minima. Until then every
    close is on the zone's near side, so a bar is inside exactly if its high (supply) or low (demand) gets to the near edge,
    and the separate visits are the rises to that edge, counted over the tree of rows. Demand is turned upside
    down to be the same. The last bar of a key may be unclosed and is ignored.
    """
    zones = supply_demand_zones(bars) if zones is None else zones
    keys = [*KEYS, "kind"]
    f = frame(bars, 1)
    stepped = f.add(high_before=f.lag("high"), low_before=f.lag("low")).rows()
    closed = stepped.filter(c("rn") < c("n"))
    sides = F.array(
        F.struct(F.lit("supply").alias("kind"), (-c("close")).alias("shut"), c("high").alias("near"), c("high_before").alias("near_before")),
        F.struct(F.lit("demand").alias("kind"), c("close").alias("shut"), (-c("low")).alias("near"), (-c("low_before")).alias("near_before")),
    )
    rows = cut_lineage(closed.select(*KEYS, "rn", "n", "time", F.explode(sides).alias("s")).select(*KEYS, "rn", "n", "time", "s.*"))
    supply = c("kind") == "supply"
    held = cut_lineage(zones.select(*KEYS, *_ZONE)).withColumns({"_far": F.when(supply, -c("high")).otherwise(c("low")), "_edge": F.when(supply, c("low")).otherwise(-c("high"))})
    held = first_at_or_below(held, rows, "shut", "_far", "confirmed", "_broken", strict=True, keys=keys)
    ends = rows.groupBy(*KEYS).agg((F.max("n") - 1).alias("_last"))
    held = cut_lineage(held.join(ends, list(KEYS), "left").withColumn("_until", F.coalesce(c("_broken") - 1, "_last", F.lit(0))))
    held = count_rises(held, rows, (c("near"), c("near_before")), "_edge", c("confirmed") + 2, c("_until"), "_rises", keys)
    # the first bar of a life is a visit of its own when it is inside, whatever came before
    entry = rows.select(*keys, (c("rn") - 1).alias("confirmed"), c("near").alias("_first"))
    held = held.join(entry, [*keys, "confirmed"], "left").join(rows.select(*keys, c("rn").alias("_broken"), c("time").alias("invalidated_time")), [*keys, "_broken"], "left")
    inside = F.coalesce((c("_first") >= c("_edge")) & (c("_until") > c("confirmed")), F.lit(False)).cast("long")
    held = held.withColumn("test_count", c("_rises") + inside)
    status = F.when(c("_broken").isNotNull(), "invalidated").when(c("test_count") > 0, "tested").otherwise("fresh")
    return held.select(*KEYS, *_ZONE, status.alias("status"), "test_count", "invalidated_time")


def zone_topn(bars, lifecycle: DataFrame, limit=12) -> DataFrame:
    """Standing zones nearest the last closed price, and the newest invalidated ones."""
    last = bars.filter(c("rn") == c("n") - 1).select(*KEYS, c("close").alias("last_close"))
    df = lifecycle.join(last, list(KEYS))
    distance = F.greatest(c("low") - c("last_close"), c("last_close") - c("high"), F.lit(0.0))
    df = df.withColumns({"gone": c("status") == "invalidated", "distance": distance})
    w = Window.partitionBy(*KEYS, "gone").orderBy(
        F.when(c("gone"), F.lit(0.0)).otherwise(c("distance")), c("confirmed").desc(), c("kind"), c("base_end").desc()
    )
    return df.withColumn("place", F.row_number().over(w)).filter(c("place") <= limit)
