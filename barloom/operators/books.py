"""Values of closed higher timeframes, and order blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c
from barloom.functions.exprs import timeframe_seconds
from barloom.operators.indicators import sma_stage
from barloom.operators.patterns import coarse_bars
from barloom.operators.resample import resample_htf
from barloom.operators.structure import pivot_flags
from barloom.plans.asof import asof_join
from barloom.plans.blocks import KEYS, fade_rows, frame, number_rows, running
from barloom.plans.crossing import first_at_or_below
from barloom.plans.folds import ordered_fold
from barloom.plans.tree import newest_over
from barloom.session import cut_lineage

# ---- closed higher-timeframe values ----------------------------------------------------------


def htf_closed(bars: DataFrame, coarse: DataFrame, values: dict, chart_sec: int) -> DataFrame:
    """Higher-timeframe values a bar may know: those of buckets closed by the bar's own close.

    ``coarse`` rows carry ``close_time``.
    """
    left = bars.withColumn("_close", F.timestamp_micros(F.unix_micros("time") + chart_sec * 1000000))
    got = asof_join(left, coarse, KEYS, "_close", "close_time", values)
    return got.drop("_close", "matched_time")


def first_seeded_ema(numbered: DataFrame, window: int, out: str) -> DataFrame:
    """EMA whose first value is the first close."""
    k = 2 / (window + 1)
    f = frame(numbered, fade_rows(1 - k))
    return f.scan(**{out: (1 - k, F.when(c("rn") == 1, c("close")).otherwise(c("close") * k))}).rows()


def ema1h_trend(bars: DataFrame, chart_sec: int, window=21) -> DataFrame:
    """EMA of closed hourly closes seen by each bar, and whether it is above its value an hour before."""
    hourly = number_rows(resample_htf(bars, 3600, chart_sec).withColumnRenamed("bucket", "time"), chunk=F.floor(F.unix_seconds("time") / (3600 * 4096)))
    df = htf_closed(bars, first_seeded_ema(hourly, window, "ema"), {"ema1h": "ema"}, chart_sec)
    back = max(1, round(3600 / chart_sec))
    f = frame(df, back)
    return f.add(trend_up=F.coalesce(c("ema1h") > f.lag("ema1h", back), F.lit(False))).rows()


def htf_ma_step(bars: DataFrame, unit="D", length=14, as_known=True, chart_sec=3600) -> DataFrame:
    """Moving average of coarse closes on every bar.

    ``as_known`` shows a bar only what had closed by then. The repainting form paints a bucket's own
    final value on all its bars, earlier ones included.
    """
    coarse = coarse_bars(bars, unit)
    ma = sma_stage(frame(coarse, length), length, "ma").rows()
    if as_known:
        seconds = {"D": 86400, "W": 604800}.get(unit)
        if unit == "M":
            ends = F.date_trunc("month", "time") + F.make_ym_interval(F.lit(0), F.lit(1))
        else:
            ends = F.timestamp_micros(F.unix_micros("time") + (seconds or int(unit) * 60) * 1000000)
        return htf_closed(bars, ma.withColumn("close_time", ends), {"htf_ma": "ma"}, chart_sec)
    from barloom.operators.resample import calendar_bucket

    painted = ma.select(*KEYS, c("time").alias("_bucket"), c("ma").alias("htf_ma"))
    return bars.withColumn("_bucket", calendar_bucket(unit)).join(painted, [*KEYS, "_bucket"], "left").drop("_bucket")


def htf_levels(bars: DataFrame, minutes: int, chart_sec: int, leg=3) -> DataFrame:
    """Newest and previous pivots of closed coarse bars, when a bar first knew the newest, and whether a
    later close went beyond it."""
    seconds = minutes * 60
    closed = resample_htf(bars, seconds, chart_sec).withColumnRenamed("bucket", "time")
    coarse = number_rows(closed, chunk=F.floor(F.unix_seconds("time") / (seconds * 4096)))
    f = frame(coarse, leg, leg)
    high, low = pivot_flags(f, leg, leg, True, False)
    f = f.add(is_high=high, is_low=low, known=f.lead("close_time", leg))
    sides = F.array_compact(F.array(F.when(c("is_high"), F.struct(F.lit("R").alias("side"), c("high").alias("px"))), F.when(c("is_low"), F.struct(F.lit("S").alias("side"), c("low").alias("px")))))
    found = f.rows().withColumn("p", F.explode(sides)).select(*KEYS, "p.side", "p.px", "rn", "time", "known")
    newest = F.max_by(F.struct("px", "time", "known"), "rn")
    last = found.groupBy(*KEYS, "side").agg(newest.alias("a"), F.max("rn").alias("_top"))
    before = found.join(last.select(*KEYS, "side", "_top"), [*KEYS, "side"]).filter(c("rn") < c("_top"))
    prior = before.groupBy(*KEYS, "side").agg(F.max_by("px", "rn").alias("prev_px"))
    level = last.select(*KEYS, "side", c("a.px").alias("px"), c("a.time").alias("pivot_time"), c("a.known").alias("known")).join(prior, [*KEYS, "side"], "left")
    # the bar that first knows a level only sets it; the first later close beyond it ends it
    level = level.withColumn("_from", F.timestamp_micros(F.unix_micros("known") - chart_sec * 1000000))
    level = asof_join(level, bars.select(*KEYS, "rn", "time"), KEYS, "_from", "time", {"_rn": "rn"}, forward=True).withColumnRenamed("matched_time", "seen")
    level = cut_lineage(level.drop("_from"))
    ended = []
    for side, shut, edge in (("R", -c("close"), -c("px")), ("S", c("close"), c("px"))):
        ended.append(first_at_or_below(level.filter(c("side") == side).withColumn("_edge", edge), bars, shut, "_edge", "_rn", "_end", strict=True))
    df = ended[0].unionByName(ended[1])
    return df.withColumn("active", c("seen").isNotNull() & c("_end").isNull()).drop("_edge", "_rn", "_end")


# ---- order blocks ----------------------------------------------------------------------------

WAIT_BARS, SWING = 20, 5
BREAK_INPUTS = ("rn", "open", "close", "pivot_high", "pivot_low")
BREAK_START = {"ceiling": None, "floor": None, "trend": 0}


def _break_step(s, values):
    """Closes beyond the newest unbroken swing; a break against the trend changes its character."""
    rn, open_, close, high, low = values
    ceiling, floor = s["ceiling"] if high is None else high, s["floor"] if low is None else low
    ways = [w for w, level in ((1, ceiling), (-1, floor)) if level is not None and (close - level) * w > 0]
    if len(ways) == 2:
        ways = [1 if close > open_ else -1]
    out = [(rn, w, s["trend"] == -w, ceiling if w > 0 else floor) for w in ways]
    return {"ceiling": None if 1 in ways else ceiling, "floor": None if -1 in ways else floor, "trend": ways[0] if ways else s["trend"]}, out


def structure_breaks(framed_rows: DataFrame, block=None) -> DataFrame:
    """Rows (rn, way, choch, swing_price); only the open swings and the trend are remembered."""
    return ordered_fold(framed_rows, BREAK_INPUTS, BREAK_START, _break_step, "rn long, way long, choch boolean, swing_price double", block=block, warmup=200)


def block_inputs(bars: DataFrame, swing=SWING) -> DataFrame:
    """Pivots as they become known and fresh three-candle imbalances."""
    f = frame(bars, 2 * swing + 4, swing)
    high, low = pivot_flags(f, swing, swing, True, False)
    f = f.add(_ph=F.when(high, c("high")), _pl=F.when(low, c("low")))
    h2, l2, h3, l3 = f.lag("high", 2), f.lag("low", 2), f.lag("high", 3), f.lag("low", 3)
    made = F.when((l2 < l3) & (c("low") > h2), 1).when((h2 > h3) & (c("high") < l2), -1)
    return f.add(
        pivot_high=f.lag("_ph", swing), pivot_low=f.lag("_pl", swing), made=F.when(c("rn") >= 4, made).cast("long"), made_top=h2, made_bottom=l2,
        made_far=F.when(made > 0, c("low")).otherwise(c("high")),
    ).rows()


def order_block_zones(bars, block=None, wait=WAIT_BARS, scan=None) -> tuple[DataFrame, DataFrame]:
    """(zones, rows of bars): one row a zone with the bars at which it is made, fresh, mitigated and broken.

    A zone needs a structure break of its own way on its last two bars, or within ``wait`` bars before price returns
    to it; its first later return mitigates it, and a close through its far side from then on makes it a breaker.
    Zones of every bar are followed; with ``scan`` only those made in that many bars before the last one, and
    then earlier rows change as bars are added. ``gap_far`` is the far edge of the imbalance.
    """
    rows = cut_lineage(block_inputs(bars))
    breaks = cut_lineage(structure_breaks(rows, block))
    made = rows.filter("made is not null")
    if scan is not None:
        made = made.filter(c("rn") - 1 >= c("n") - 1 - scan)
    zones = made.select(*KEYS, c("rn").alias("born"), c("made").alias("direction"), c("made_top").alias("top"), c("made_bottom").alias("bottom"), c("made_far").alias("gap_far"))
    sign = c("direction")
    # The bars from one before birth to the end of the wait, each an equi join on its row.
    near = zones.withColumn("ahead", F.explode(F.sequence(F.lit(-1), F.lit(wait)))).withColumn("rn", c("born") + c("ahead"))
    near = near.join(rows.select(*KEYS, "rn", "high", "low"), [*KEYS, "rn"])
    near = near.join(breaks, [*KEYS, "rn"], "left")
    same = c("way") == sign
    back = F.when(sign > 0, c("low") <= c("top")).otherwise(c("high") >= c("bottom"))
    hit = F.struct("rn", "choch", "swing_price")
    first = near.groupBy(*KEYS, "born", "direction", "top", "bottom", "gap_far").agg(
        F.max_by(hit, F.when(same & (c("ahead") <= 0), c("rn"))).alias("had"), F.min_by(hit, F.when(same & (c("ahead") > 0), c("rn"))).alias("got"),
        F.min(F.when(back & (c("ahead") > 0), c("rn"))).alias("returned"),
    )
    in_time = c("got").isNotNull() & (c("returned").isNull() | (c("returned") > c("got.rn")))
    first = first.withColumn("by", F.when(c("had").isNotNull(), c("had")).when(in_time, c("got"))).filter("by is not null")
    fresh = first.select(
        *KEYS, "born", (c("born") - 2).alias("ob_rn"), "direction", "top", "bottom", "gap_far", F.greatest("born", "by.rn").alias("fresh"), c("by.rn").alias("confirm_rn"),
        c("by.choch").alias("choch"), c("by.swing_price").alias("swing_price"),
    )
    # Both ways become "falls to a level" by turning bearish zones upside down.
    up, down = fresh.filter(sign > 0), fresh.filter(sign < 0)
    sides = []
    for side, reach, shut, entry, exit_ in ((up, c("low"), c("close"), c("top"), c("bottom")), (down, -c("high"), -c("close"), -c("bottom"), -c("top"))):
        side = side.withColumns({"_in": entry, "_out": exit_})
        side = first_at_or_below(side, rows, reach, "_in", "fresh", "mitigated").withColumn("_since", c("mitigated") - 1)
        sides.append(first_at_or_below(side, rows, shut, "_out", "_since", "break_rn", strict=True))
    known = cut_lineage(sides[0].unionByName(sides[1]).drop("_in", "_out", "_since"))
    return known, rows


def order_blocks(bars, block=None, wait=WAIT_BARS, scan=None) -> DataFrame:
    """Zone events (fresh, mitigated, breaker) and the states standing at the last bar.

    A bar that both returns to a zone and closes through it gives both events.
    """
    known, rows = order_block_zones(bars, block, wait, scan)
    ends = rows.filter(c("rn") == c("n")).select(*KEYS, c("rn").alias("_end"))
    known = known.join(ends, list(KEYS))
    state = F.when(c("break_rn").isNotNull(), "breaker").when(c("mitigated").isNotNull(), "mitigated").otherwise("fresh")
    event = lambda name, at: F.when(at.isNotNull(), F.struct(name.alias("event"), at.alias("rn")))
    events = F.array_compact(F.array(event(F.lit("fresh"), c("fresh")), event(F.lit("mitigated"), c("mitigated")), event(F.lit("breaker"), c("break_rn")), event(F.concat(F.lit("final:"), state), c("_end"))))
    out = known.withColumn("e", F.explode(events)).select(
        *KEYS, "e.rn", "e.event", "ob_rn", "direction", "top", "bottom", "choch", "confirm_rn", "swing_price", F.when(c("break_rn") <= c("e.rn"), c("break_rn")).alias("break_rn"),
    )
    times = rows.select(*KEYS, "rn", "time")
    return out.join(times, [*KEYS, "rn"]).select(
        *KEYS, "rn", "time", "event", "ob_rn", "direction", "top", "bottom", "choch", "confirm_rn", "swing_price", "break_rn"
    )


def order_block_levels(bars, block=None, wait=WAIT_BARS, scan=None) -> DataFrame:
    """Per bar the newest standing bullish and bearish block, the newest breaker, and how many stand in each state.

    A breaker of a bullish zone counts as bearish and the other way round. Each zone's life is laid over a tree of
    rows, so that a bar finds the newest zone on its path; the counts are running sums of what begins and ends.
    """
    zones, rows = order_block_zones(bars, block, wait, scan)
    zones = zones.join(rows.filter(c("rn") == c("n")).select(*KEYS, c("n").alias("_end")), list(KEYS))
    shape = F.struct("born", "top", "bottom", "gap_far")
    stands = F.struct(c("fresh").alias("a"), F.coalesce(c("break_rn") - 1, c("_end")).alias("b"), F.lit(False).alias("broken"))
    broken = F.when(c("break_rn").isNotNull(), F.struct(c("break_rn").alias("a"), c("_end").alias("b"), F.lit(True).alias("broken")))
    lives = cut_lineage(zones.withColumn("l", F.explode(F.array_compact(F.array(stands, broken)))).select(*KEYS, "direction", shape.alias("zone"), "l.*"))
    way = lambda d: F.when(~c("broken") & (c("direction") == d), c("zone"))
    seen = newest_over(rows, lives, "a", "b", {"bull": way(1), "bear": way(-1), "breaker": F.when(c("broken"), c("zone"))})
    states, changes = [], []
    for name, begins, ends in (("fresh", c("fresh"), F.coalesce("mitigated", "break_rn")), ("mitigated", F.when(~F.coalesce(c("break_rn") <= c("mitigated"), F.lit(False)), c("mitigated")), c("break_rn")), ("breaker", c("break_rn"), F.lit(None).cast("long"))):
        for d, side in ((1, "bull"), (-1, "bear")):
            kept = c("direction") == (-d if name == "breaker" else d)
            column = f"{name}_{side}"
            states.append(column)
            changes += [F.when(kept & begins.isNotNull(), F.struct(begins.alias("rn"), F.lit(column).alias("state"), F.lit(1).alias("by")))]
            changes += [F.when(kept & begins.isNotNull() & ends.isNotNull(), F.struct(ends.alias("rn"), F.lit(column).alias("state"), F.lit(-1).alias("by")))]
    moved = zones.select(*KEYS, F.explode(F.array_compact(F.array(*changes))).alias("e")).select(*KEYS, "e.*")
    moved = moved.groupBy(*KEYS, "rn").agg(*(F.sum(F.when(c("state") == x, c("by")).otherwise(0)).alias(f"_{x}") for x in states))
    counted = running(seen.join(moved, [*KEYS, "rn"], "left"), {x: ("sum", F.coalesce(c(f"_{x}"), F.lit(0))) for x in states})
    edge = lambda side: [c(f"{side}.{k}").alias(f"{side}_{k}") for k in ("top", "bottom", "gap_far")]
    return counted.select(*KEYS, "rn", "time", *edge("bull"), *edge("bear"), *edge("breaker"), *states)
