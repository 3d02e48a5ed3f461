"""Annotations against the bars they are drawn on, and alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c
from barloom.plans.blocks import KEYS

FORWARD_BARS = 150
# Most marks, scenarios and path points.
CAPS = {"annotations": 24, "scenarios": 6, "points": 12}


def window_stats(bars: DataFrame) -> DataFrame:
    """Price band, first and last bar of each key, and how far ahead a path may reach."""
    g = bars.groupBy(*KEYS).agg(
        F.min("low").alias("lo"), F.max("high").alias("hi"), F.min("time").alias("first"), F.max("time").alias("last"),
        F.max(F.when(c("rn") == c("n") - 1, c("time"))).alias("_before"), F.max(F.when(c("rn") == c("n"), c("close"))).alias("last_close"),
    )
    us = F.unix_micros
    bar = F.coalesce(us("last") - us("_before"), F.lit(0))
    ahead = F.greatest(((us("last") - us("first")) * 0.1).cast("long"), bar * FORWARD_BARS)
    return g.withColumn("limit", F.timestamp_micros(us("last") + ahead)).drop("_before")


def band_of(role, lo="lo", hi="hi", cross=None):
    """(floor, ceiling) a price must lie in; targets and invalidations get a wider one."""
    wide = c(role).isin("target", "invalidation")
    low, high = c(lo), c(hi)
    pad = F.greatest((high - low) * 0.3, (high + low) * 0.015)
    tight_low, tight_high = (low * 0.7, high * 1.3) if cross is None else (
        F.when(c(cross), low - pad).otherwise(low * 0.7), F.when(c(cross), high + pad).otherwise(high * 1.3)
    )
    return F.when(wide, low * 0.5).otherwise(tight_low), F.when(wide, high * 2.0).otherwise(tight_high)


def in_band(price: Column, floor: Column, ceiling: Column) -> Column:
    return F.coalesce((price >= floor) & (price <= ceiling), F.lit(False))


def clip_path(points: Column, first: Column) -> Column:
    """Polyline cut at the window start by interpolation; untouched when it starts inside.

    ``points`` is array<struct<time, price>> in drawing order; paths hold a few points.
    """
    us = lambda t: F.unix_micros(t)
    start = us(first)
    n = F.size(points)
    nth = lambda k: F.get(points, k)
    steps = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    rising = F.forall(steps, lambda k: (n < 2) | (us(nth(k + 1)["time"]) > us(nth(k)["time"])))
    whole = rising & F.forall(points, lambda p: us(p["time"]) >= start)
    eight = lambda x: F.when(x == 0, 0.0).otherwise(F.round(x / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 7)) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 7))

    def segment(k):
        a, b = nth(k), nth(k + 1)
        ta, tb = us(a["time"]), us(b["time"])
        cut = (ta < start) & (tb >= start)
        price = F.when(cut, a["price"] + (b["price"] - a["price"]) * ((start - ta) / F.nullif(tb - ta, F.lit(0)))).otherwise(a["price"])
        head = F.struct(F.when(cut, first).otherwise(a["time"]).alias("time"), eight(price).alias("price"))
        tail = F.struct(b["time"].alias("time"), eight(b["price"]).alias("price"))
        return F.when((tb > ta) & (tb >= start), F.array(head, tail)).otherwise(F.array().cast("array<struct<time:timestamp,price:double>>"))

    joined = F.flatten(F.transform(steps, segment))
    # A later vertex at the same instant replaces the earlier one.
    kept = F.filter(joined, lambda p, i: (i == F.size(joined) - 1) | (F.abs(us(F.get(joined, i + 1)["time"]) - us(p["time"])) >= 1000))
    return F.when(n < 2, F.lit(None)).when(whole, points).when(F.size(kept) >= 2, kept)


def join_marks(marks: DataFrame, bars: DataFrame) -> DataFrame:
    """Marks that may be shown on each key's bars.

    A mark has symbol, source, timeframe, type (level, zone, path or another), role, price, low, high,
    available_at, points. The bars carry ``source``; one statistics row per key is joined.
    """
    shown = window_stats(bars).withColumnsRenamed({"timeframe": "shown_timeframe"})
    df = marks.withColumn("symbol", F.upper(F.trim("symbol"))).join(shown.withColumn("symbol", F.upper("symbol")), "symbol")
    df = df.withColumn("cross_tf", c("timeframe") != c("shown_timeframe"))
    floor, ceiling = band_of("role", cross="cross_tf")
    fits = lambda x: in_band(x, floor, ceiling)
    known = c("available_at").isNull() | (c("available_at") <= c("last"))
    clipped = clip_path(c("points"), c("first"))
    df = df.withColumn("drawn", F.when(c("cross_tf"), clipped).otherwise(c("points")))
    inside = F.forall("drawn", lambda p: in_band(p["price"], floor, ceiling))
    on_time = c("cross_tf") | F.forall("points", lambda p: (p["time"] >= c("first")) & (p["time"] <= c("limit")))
    path = (F.size(F.coalesce("points", F.array())) >= 2) & c("drawn").isNotNull() & F.coalesce(inside, F.lit(False)) & F.coalesce(on_time, F.lit(False))
    keep = (
        F.when(c("type") == "level", fits(c("price"))).when(c("type") == "zone", known & fits(c("low")) & fits(c("high"))).when(c("type") == "path", path).otherwise(True)
    )
    return df.withColumn("kept", keep)


def combine_marks(current: DataFrame, new: DataFrame, candidates: bool) -> DataFrame:
    """New candidate zones replace the old ones only, other drawings replace other drawings only.

    Keys of ``new`` are (source, symbol); a key it does not touch stays as it was.
    """
    touched = new.select("source", "symbol").distinct().withColumn("_touched", F.lit(True))
    cand = (c("type") == "zone") & c("available_at").isNotNull()
    stays = cand if not candidates else ~cand
    kept = current.join(touched, ["source", "symbol"], "left").filter(c("_touched").isNull() | stays).drop("_touched")
    return kept.unionByName(new)


def annotation_gate(marks: DataFrame, bars: DataFrame) -> DataFrame:
    """Violations per proposed mark against the bars of its own symbol and timeframe."""
    df = marks.join(window_stats(bars), list(KEYS), "left")
    floor, ceiling = band_of("role")
    off = lambda x: ~in_band(x, floor, ceiling)
    level, zone, path = (c("type") == t for t in ("level", "zone", "path"))
    points = F.coalesce(F.size("points"), F.lit(0))
    tests = {
        "no_bars": c("last").isNull(),
        "price_out_of_band": (level & off(c("price"))) | (zone & (off(c("low")) | off(c("high")))) | (path & F.exists("points", lambda p: ~in_band(p["price"], floor, ceiling))),
        "zone_order": zone & ~F.coalesce(c("low") < c("high"), F.lit(False)),
        "zone_too_thin": zone & (c("high") - c("low") < c("last_close") * 0.0005) & (c("low") < c("high")),
        "point_count": path & ((points < 2) | (points > CAPS["points"])),
        "point_time": path & F.exists("points", lambda p: (p["time"] < c("first")) | (p["time"] > c("limit"))),
        "confidence": (c("confidence") < 0) | (c("confidence") > 1),
        "no_sources": F.size(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.trim(s) != "")) == 0,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
    return df.withColumn("violations", found)


def over_caps(marks: DataFrame, request="request_id") -> DataFrame:
    """Requests holding more marks than allowed."""
    return marks.groupBy(request).agg(F.count(F.lit(1)).alias("marks")).withColumn("too_many", c("marks") > CAPS["annotations"])


# ---- alerts ----------------------------------------------------------------------------------


def alert_rows(df: DataFrame, flags: dict, last_closed_only=True) -> DataFrame:
    """One row per raised flag; the id is the bar time and the flag's code, so repeats collapse.

    ``flags`` maps a code to a boolean column. The last bar may be open, so alerts come from the one
    before it.
    """
    closed = df.filter(c("rn") == c("n") - 1) if last_closed_only else df.filter(c("rn") < c("n"))
    raised = F.filter(F.array(*[F.struct(F.lit(code).alias("code"), c(x).alias("on")) for code, x in flags.items()]), lambda x: x["on"])
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return closed.withColumn("a", F.explode(raised)).select(*KEYS, "time", "rn", F.concat_ws("|", stamp, "a.code").alias("alert_id"), "a.code")


# ---- series upkeep ---------------------------------------------------------------------------


def merge_tail(series: DataFrame, fresh: DataFrame, keys=(*KEYS, "time")) -> DataFrame:
    """Keyed upsert by bar time: the highest ``seq`` wins."""
    both = series.unionByName(fresh)
    fields = [x for x in both.columns if x not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*fields), "seq").alias("v")).select(*keys, "v.*")


def older_than(bars: DataFrame, before, order="seq") -> DataFrame:
    """Bars opening strictly before an instant, the first of duplicates kept."""
    out = bars.filter(c("time") < c(before))
    fields = [x for x in out.columns if x not in (*KEYS, "time")]
    return out.groupBy(*KEYS, "time").agg(F.min_by(F.struct(*fields), order).alias("v")).select(*KEYS, "time", "v.*")


def split_by_available(wanted: DataFrame, available: DataFrame, key="symbol"):
    """(present, skipped): symbols whose source has no data are left out, not an error."""
    have = available.select(key).distinct()
    return wanted.join(have, key, "left_semi"), wanted.join(have, key, "left_anti")
