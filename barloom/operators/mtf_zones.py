"""Support and resistance zones of several timeframes, by UTC day.

Zones of different days never meet: pivots of a day spawn the day's zones, which unite among themselves and lose the
weakest above a cap, so a day is a small fold of its own and all days of all keys run side by side. A bar then sees the
newest version of its own day and the last version of the days just before it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.functions.exprs import col as c
from barloom.operators.indicators import atr_progressive
from barloom.operators.structure import pivot_flags
from barloom.plans.blocks import KEYS, frame, number_rows
from barloom.session import cut_lineage

# Slots (minutes), score weights and limits.
SLOTS = (30, 60, 120, 240)
WEIGHTS = {"tf": 0.40, "confluence": 0.28, "wick": 0.18, "prominence": 0.14}
BONUS, THICK, MERGE, CAP, SESSIONS, PIVOT = 0.9, 0.28, 0.35, 14, 3, 5


def slot_label(seconds: int) -> str:
    if seconds % 86400 == 0:
        return f"D{seconds // 86400}"
    return f"H{seconds // 3600}" if seconds % 3600 == 0 else f"M{round(seconds / 60)}"


def slot_weight(seconds: int) -> float:
    for least, weight in ((14400, 1.0), (3600, 0.78), (900, 0.55), (300, 0.38), (60, 0.30)):
        if seconds >= least:
            return weight
    return 0.25


def strength(tf, count, wick, prominence, atr) -> float:
    unit = lambda x: min(1.0, max(0.0, x))
    parts = {
        "tf": unit(tf), "confluence": unit((count - 1) / 2), "wick": unit(wick / (atr * 0.6)) if atr > 0 else 0.0,
        "prominence": unit(prominence / (atr * 3)) if atr > 0 else 0.0,
    }
    raw = sum(parts[k] * w for k, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    return min(10.0, max(0.0, raw * 10 + BONUS * (count - 1)))


def strength_score(tf, count, wick, prominence, atr) -> Column:
    """The same score as a column expression."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    safe = F.nullif(c(atr), F.lit(0.0))
    rel = lambda x, k: F.when(c(atr) > 0, unit(c(x) / (safe * k))).otherwise(0.0)
    raw = (
        unit(c(tf)) * WEIGHTS["tf"] + unit((c(count) - 1) / 2.0) * WEIGHTS["confluence"] + rel(wick, 0.6) * WEIGHTS["wick"]
        + rel(prominence, 3.0) * WEIGHTS["prominence"]
    ) / sum(WEIGHTS.values())
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), raw * 10 + BONUS * (c(count) - 1)))


def tier(score) -> Column:
    s = c(score)
    return F.when(s >= 8, "ELITE").when(s >= 6.5, "STRONG").when(s >= 5, "MODERATE").when(s >= 3.5, "WEAK").otherwise("FORMING")


def star_text(score) -> Column:
    s = c(score)
    return F.when(s >= 8, "★★★★★").when(s >= 6.5, "★★★★").when(s >= 5, "★★★").when(s >= 3.5, "★★").when(s >= 2, "★").otherwise("·")


def mtf_pivots(bars: DataFrame, source_sec: int, slots=SLOTS, arm=PIVOT) -> DataFrame:
    """Pivots of every slot with the bar that confirms each, its wick and its distance from the mean.

    All slots share one grouping, one numbering and one frame, keyed by (keys, slot). A bucket is proven closed by its
    last bar where that reaches the bucket's end, else by the next bar; only the last bucket may stay unproven, and a
    pivot whose right leg ends there has no confirming bar.
    """
    used = [(k, m * 60, slot_label(m * 60), slot_weight(m * 60)) for k, m in enumerate(slots) if source_sec <= m * 60]
    slot = F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(s).cast("long").alias("seconds"), F.lit(label).alias("label"), F.lit(float(w)).alias("weight")) for k, s, label, w in used))
    each = bars.withColumn("s", F.explode(slot)).select(*KEYS, "s.*", "time", "open", "high", "low", "close")
    keys = (*KEYS, "slot", "seconds", "label", "weight")
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("time") / c("seconds")) * c("seconds"))
    coarse = each.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
    )
    numbered = number_rows(coarse, keys=keys, order=("bucket",), chunk=F.floor(F.unix_seconds("bucket") / (c("seconds") * 4096)))
    f = frame(numbered, 2 * arm, arm + 1, keys=keys)
    high, low = pivot_flags(f, arm, arm, False, True)
    full = F.unix_seconds("last_time") + source_sec >= F.unix_seconds("bucket") + c("seconds")
    f = f.add(is_high=high, is_low=low, _mean=F.avg((c("high") + c("low")) / 2).over(f.last(2 * arm)), _proven=F.when(full, c("last_time")).otherwise(f.lead("first_time")))
    f = f.add(mean=f.lead("_mean", arm), at=f.lead("_proven", arm))
    pos = lambda x: F.greatest(x, F.lit(0.0))
    side = lambda res, level, wick, beyond: F.struct(F.lit(res).alias("res"), level.alias("level"), pos(wick).alias("wick"), pos(beyond).alias("prominence"))
    res = F.when(c("is_high"), side(True, c("high"), c("high") - F.greatest("open", "close"), c("high") - c("mean")))
    sup = F.when(c("is_low"), side(False, c("low"), F.least("open", "close") - c("low"), c("mean") - c("low")))
    found = f.rows().filter("at is not null").withColumn("p", F.explode(F.array_compact(F.array(res, sup))))
    return found.select(*KEYS, c("at").alias("time"), "slot", c("rn").alias("coarse_rn"), "label", "weight", "p.*")


ZONE = (
    "res boolean, level double, top double, bottom double, score double, frames array<string>, weight double, "
    "wick_sum double, wick_n long, prominence double, start_rn long"
)
_EVENT = ("rn", "slot", "coarse_rn", "o", "atr", "res", "level", "wick", "prominence", "label", "weight")


def _banded(zone: dict, atr: float) -> dict:
    """The zone with its band and score at the current range."""
    half = max(atr * THICK, 1e-6) / 2
    wick = zone["wick_sum"] / max(zone["wick_n"], 1)
    score = strength(zone["weight"], len(zone["frames"]), wick, zone["prominence"], atr)
    return zone | {"top": zone["level"] + half, "bottom": zone["level"] - half, "score": score}


def _of_both(old: dict, new: dict, atr: float) -> dict:
    """One zone of two: the level weighed by tests, sums of tests, the larger of weight and prominence."""
    tests = max(old["wick_n"], 1), max(new["wick_n"], 1)
    total = {k: old[k] + new[k] for k in ("wick_sum", "wick_n")}
    most = {k: max(old[k], new[k]) for k in ("weight", "prominence")}
    level = (old["level"] * tests[0] + new["level"] * tests[1]) / sum(tests)
    frames = old["frames"] + [x for x in new["frames"] if x not in old["frames"]]
    return _banded(old | total | most | {"level": level, "frames": frames}, atr)


def _apart(zones: list[dict], atr: float) -> list[dict]:
    """Unite intervals of a side that come within reach until none do.

    The earliest zone with one in reach takes in the first such; as it moves by that, all are looked at again.
    """
    zones, reach, k = list(zones), atr * MERGE, 0
    while k < len(zones):
        a = zones[k]
        met = next((j for j in range(k + 1, len(zones)) if zones[j]["res"] == a["res"] and max(a["bottom"], zones[j]["bottom"]) <= min(a["top"], zones[j]["top"]) + reach), None)
        if met is None:
            k += 1
        else:
            zones[k], k = _of_both(a, zones.pop(met), atr), 0
    return zones


def day_versions(events: list[dict], cap: int | None) -> list[dict]:
    """The zones of one day after each bar that spawned some; ``events`` are the day's pivots in their order."""
    zones, versions, newest = [], [], {}
    for at, e in enumerate(events):
        key = e["slot"], e["res"]
        if not (key in newest and abs(newest[key] - e["level"]) <= 1e-9):
            newest[key] = e["level"]
            born = {"res": e["res"], "level": e["level"], "frames": [e["label"]], "weight": e["weight"], "wick_sum": e["wick"], "wick_n": int(e["wick"] > 0), "prominence": e["prominence"], "start_rn": e["rn"]}
            zones = [*zones, _banded(born, e["atr"])]
            if not versions or versions[-1]["rn"] != e["rn"]:
                versions.append({"rn": e["rn"]})
        last_of_bar = at + 1 == len(events) or events[at + 1]["rn"] != e["rn"]
        if last_of_bar and versions and versions[-1]["rn"] == e["rn"]:
            zones = _apart(zones, e["atr"])
            if cap is not None and len(zones) > cap:
                weak = sorted(range(len(zones)), key=lambda k: zones[k]["score"])[: len(zones) - cap]
                zones = [z for k, z in enumerate(zones) if k not in weak]
            versions[-1]["zones"] = zones
    return versions


def zone_versions(bars: DataFrame, source_sec: int, slots=SLOTS, last_closed=True, cap=CAP) -> DataFrame:
    """Rows (keys, day, rn, zones): the day's zones from bar ``rn`` on, until the next row of the day.

    With ``last_closed`` false the last bar is still forming and confirms nothing. The pivots of a day, a few dozen at
    most, are folded together; days are apart.
    """
    closed = bars if last_closed else bars.filter(c("rn") < c("n")).withColumn("n", c("n") - 1)
    ranged = atr_progressive(closed, 14, "atr").select(*KEYS, "time", "rn", F.coalesce(F.nullif("atr", F.lit(0.0)), F.lit(1e-6)).alias("atr"))
    events = mtf_pivots(closed, source_sec, slots).join(ranged, [*KEYS, "time"]).withColumn("o", F.when(c("res"), 0).otherwise(1))
    days = events.groupBy(*KEYS, _day().alias("day")).agg(F.sort_array(F.collect_list(F.struct(*_EVENT))).alias("events"))
    schema = T.StructType([*(bars.schema[k] for k in KEYS), *T._parse_datatype_string(f"day long, versions array<struct<rn:long,zones:array<struct<{ZONE}>>>>").fields])
    arrow = to_arrow_schema(schema)

    def fold(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["versions"] = day_versions(row.pop("events"), cap)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return cut_lineage(days.mapInArrow(fold, schema)).withColumn("v", F.explode("versions")).select(*KEYS, "day", "v.*")


def _day() -> Column:
    return F.floor(F.unix_seconds("time") / 86400)


def visible_zones(bars: DataFrame, versions: DataFrame, sessions=SESSIONS) -> DataFrame:
    """``bars`` with ``zones``: the last version of each of the days with bars just before, oldest first, then today's newest."""
    final = versions.groupBy(*KEYS, "day").agg(F.max_by("zones", "rn").alias("final"))
    days = bars.select(*KEYS, _day().alias("day")).distinct().join(final, [*KEYS, "day"], "left")
    by_day = Window.partitionBy(*KEYS).orderBy("day")
    none = F.array().cast(versions.schema["zones"].dataType)
    before = [F.coalesce(F.lag("final", k).over(by_day), none) for k in range(sessions - 1, 0, -1)]
    days = days.select(*KEYS, "day", (F.concat(*before) if before else none).alias("_old"))
    so_far = Window.partitionBy(*KEYS, "day").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    seen = bars.withColumn("day", _day()).join(versions.withColumnRenamed("zones", "_new"), [*KEYS, "day", "rn"], "left")
    seen = seen.withColumn("_new", F.last("_new", ignorenulls=True).over(so_far)).join(days, [*KEYS, "day"])
    return seen.withColumn("zones", F.concat("_old", F.coalesce("_new", none))).drop("_old", "_new", "day")


def _nearest(wanted, distance) -> Column:
    """The level of the nearest wanted zone, the first of equally near ones."""
    at = lambda z, k: F.when(wanted(z), F.struct(distance(z["level"]).alias("d"), k.alias("k"), z["level"].alias("level")))
    return F.array_min(F.transform("zones", at))["level"]


def mtf_sr(bars: DataFrame, source_sec: int, slots=SLOTS, last_closed=True, cap=CAP, sessions=SESSIONS) -> DataFrame:
    """Nearest levels per bar (kind bar) and the zones standing at the end (kind zone, ``place`` in their order).

    ``cap`` zones a day (None: all) of ``sessions`` days are kept. With ``last_closed`` false the last bar is still
    forming: it confirms no pivot, but its close is measured like any other. A level on the far side of the
    close counts twice its distance.
    """
    seen = visible_zones(bars, zone_versions(bars, source_sec, slots, last_closed, cap), sessions)
    ahead = lambda gap: F.when(gap >= 0, gap).otherwise(-2 * gap)
    res = _nearest(lambda z: z["res"], lambda level: ahead(level - c("close")))
    sup = _nearest(lambda z: ~z["res"], lambda level: ahead(c("close") - level))
    both = _nearest(lambda z: F.size(z["frames"]) > 1, lambda level: F.abs(level - c("close")))
    blank = lambda kind: F.lit(None).cast(kind)
    bar = F.struct(
        F.lit("bar").alias("kind"), blank("boolean").alias("res"), *(blank("double").alias(k) for k in ("level", "top", "bottom", "score")), blank("string").alias("frames"), blank("long").alias("confluence"),
        *(blank("double").alias(k) for k in ("wick_avg", "prominence")), blank("long").alias("start_rn"), sup.alias("support"), res.alias("resistance"), both.alias("confluence_level"), blank("long").alias("place"),
    )

    def zone(z, k):
        return F.struct(
            F.lit("zone").alias("kind"), z["res"].alias("res"), *(z[k].alias(k) for k in ("level", "top", "bottom", "score")), F.array_join(z["frames"], ",").alias("frames"), F.size(z["frames"]).cast("long").alias("confluence"),
            (z["wick_sum"] / F.greatest(z["wick_n"], F.lit(1))).alias("wick_avg"), z["prominence"].alias("prominence"), z["start_rn"].alias("start_rn"),
            *(blank("double").alias(k) for k in ("support", "resistance", "confluence_level")), k.cast("long").alias("place"),
        )

    standing = F.when(c("rn") == c("n"), F.transform("zones", zone)).otherwise(F.array())
    return seen.select(*KEYS, "rn", "time", F.explode(F.concat(F.array(bar), standing)).alias("r")).select(*KEYS, "rn", "time", "r.*")


def zone_dashboard(zones: DataFrame, bars: DataFrame, slots=SLOTS) -> DataFrame:
    """Strongest zone, nearest levels, room in ATR, averages and counts per timeframe, one row per key."""
    last = atr_progressive(bars, 14, "atr").filter(c("rn") == c("n")).select(*KEYS, c("close").alias("last_close"), "atr")
    z = zones.filter(c("kind") == "zone").join(last, list(KEYS))
    pick = lambda when, distance: F.min_by(c("level"), F.when(when, F.struct(distance, "place")))
    above, below = c("level") - c("last_close"), c("last_close") - c("level")
    counts = []
    for m in slots:
        has = F.array_contains(F.split("frames", ","), slot_label(m * 60))
        for side, is_res in (("res", True), ("sup", False)):
            counts.append(F.count_if(has & (c("res") == is_res)).alias(f"{slot_label(m * 60)}_{side}"))
    g = z.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("zones"), F.count_if(c("confluence") > 1).alias("confluences"), F.avg("score").alias("avg_score"),
        F.max_by(F.struct("level", "score"), F.struct("score", -c("place"))).alias("strongest"),
        F.coalesce(pick(c("res") & (above >= 0), above), F.min_by("level", F.when(c("res"), c("place")))).alias("nearest_res"),
        F.coalesce(pick(~c("res") & (below >= 0), below), F.min_by("level", F.when(~c("res"), c("place")))).alias("nearest_sup"),
        F.max("atr").alias("atr"), F.max("last_close").alias("last_close"), *counts,
    )
    room = (c("nearest_res") - c("nearest_sup")) / F.greatest(c("atr"), F.lit(1e-9))
    where = F.when(c("last_close") - c("nearest_sup") < c("nearest_res") - c("last_close"), "Near SUP").when(room.isNotNull(), "Near RES")
    out = g.withColumns({"room_atr": room, "price_position": where, "strongest_level": c("strongest.level"), "strongest_score": c("strongest.score")})
    for m in slots:
        label = slot_label(m * 60)
        r, s = c(f"{label}_res"), c(f"{label}_sup")
        out = out.withColumn(f"{label}_bias", F.when(r + s == 0, "—").when(r > s, "RES").when(s > r, "SUP").otherwise("BAL"))
    return out.drop("strongest")
