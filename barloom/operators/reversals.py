"""Reversal points on two scales, exhaustion bursts and the open candidate.

One generic follower of turns finds where price has come back from its extreme by a share; it remembers only where
its extremes lie. What a point means (volume, open interest, levels, divergence, trend lines) is a matter of
the extreme's own bar and the confirming bar, computed for all bars with windows and fetched by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c
from barloom.functions.exprs import fixed_digits
from barloom.operators.books import ema1h_trend, htf_levels
from barloom.operators.indicators import atr_stage, bollinger_stage, rsi_rows, rsi_stage, sma_stage
from barloom.plans.blocks import KEYS, fade_rows, frame
from barloom.plans.folds import ordered_fold
from barloom.session import cut_lineage

# Fixed values of the reversal rules.
FINE, BIG = 0.007, 0.02
VOL_STAR, VOL_DRY, VOL_GIANT = 2.0, 0.7, 4.0
OI_TOP, OI_BOTTOM = 0.3, -0.25
BURST_GAP = 6
#: Higher timeframes of the report (name, minutes).
HIGHER = (("1h", 60), ("4h", 240))


def closed_bars(bars: DataFrame, last_closed: bool) -> DataFrame:
    """All bars, or those before the last one where that is still forming."""
    return bars if last_closed else bars.filter(c("rn") < c("n")).withColumn("n", c("n") - 1)


def reversal_inputs(bars: DataFrame, chart_sec: int, oi: DataFrame | None = None, lookback_hours=24) -> DataFrame:
    """What a reversal rule reads on one bar, for tops (``at_top``) and bottoms (``at_low``)."""
    trend = ema1h_trend(bars, chart_sec)
    if oi is None:
        trend = trend.withColumn("bar_oi", F.lit(None).cast("double"))
    else:
        trend = trend.join(oi.select(*KEYS, "time", "bar_oi"), [*KEYS, "time"], "left")
    hour = max(1, round(3600 / chart_sec))
    half_day = max(2, round(43200 / chart_sec))
    span = max(20, round(lookback_hours * 3600 / chart_sec))
    f = frame(trend, max(rsi_rows(14), fade_rows(13 / 14) + 20, span + 8))
    f = rsi_stage(atr_stage(f, 14, "atr"), 14, "rsi14", True)
    f = bollinger_stage(sma_stage(f, 20, "_vm", c("volume")), 20, 2.0)
    full = lambda k, x: F.when(c("rn") >= k, x)
    width = c("bb_upper") - c("bb_lower")
    oi_before = f.lag("bar_oi", hour)
    f = f.add(
        vol_ratio=c("volume") / F.nullif(c("_vm"), F.lit(0.0)),
        pct_b=F.when(width == 0, 0.5).otherwise((c("close") - c("bb_lower")) / F.nullif(width, F.lit(0.0))),
        _hi=full(span, F.max("high").over(f.last(span))), _lo=full(span, F.min("low").over(f.last(span))),
        _h12=full(half_day, F.max("high").over(f.last(half_day))), _l12=full(half_day, F.min("low").over(f.last(half_day))),
        oi_chg=F.when(oi_before != 0, 100 * (c("bar_oi") - oi_before) / F.nullif(oi_before, F.lit(0.0))),
    )
    six = f.lag("close", 6)
    dry = sum((f.lag("vol_ratio", k) for k in range(2, 5)), f.lag("vol_ratio", 1)) / 4
    no = lambda x: F.coalesce(x, F.lit(False))
    side = lambda touch, extreme, stall: F.struct(no(touch).alias("touch"), no(extreme).alias("extreme"), no(stall).alias("stall"))
    return f.add(
        at_top=side(c("high") >= f.lag("_hi", 7) - 0.7 * c("atr"), c("high") >= c("_h12"), c("close") - six < 0.3 * c("atr")),
        at_low=side(c("low") <= f.lag("_lo", 7) + 0.7 * c("atr"), c("low") <= c("_l12"), six - c("close") < 0.3 * c("atr")),
        burst=no((dry <= VOL_DRY) & (c("vol_ratio") >= VOL_GIANT) & (F.abs(c("close") - c("open")) >= 1.2 * c("atr"))),
    ).rows()


def share(move: float, price: float) -> float:
    """Move relative to a price; any move from a zero price is unbounded."""
    return move / price if price else (float("inf") if move > 0 else 0.0)


TURN_SCHEMA = "kind string, rn long, at_rn long, price double, is_top boolean, open boolean, before_rn long, lows array<struct<rn:long,px:double>>"


def turn_step(levels: dict[str, float], gap: int = BURST_GAP):
    """Step that follows turns of each level at once.

    A level's state is [way, extreme, its row, rows and prices of its last two tops, of its last two bottoms]. A row gives
    one output a level that turns, naming the extreme and the turn of its side before it, one for a burst at
    least ``gap`` rows after the one before, and at the end of the key the open extreme of each level. ``lows`` are
    the last two bottoms of the last level as they stood before its own turn on the row.
    """
    *_, slow = levels

    def step(state, values):
        rn, n, high, low, burst = values
        state = state or {"burst": None} | {name: [1, high, rn, [], []] for name in levels}
        out = []
        for name, least in levels.items():
            way, extreme, at, *known = state[name]
            lows = state[slow][4]
            ahead, behind = (high, low) if way > 0 else (low, high)
            if way * (ahead - extreme) >= 0:
                extreme, at = ahead, rn
            mine = known[0 if way > 0 else 1]
            if share(way * (extreme - behind), extreme) >= least:
                out.append((name, rn, at, extreme, way > 0, False, mine[-1][0] if mine else None, lows))
                known[0 if way > 0 else 1] = [*mine[-1:], [at, extreme]]
                way, extreme, at = -way, behind, rn
            state = state | {name: [way, extreme, at, *known]}
        if burst and (state["burst"] is None or rn - state["burst"] >= gap):
            state = state | {"burst": rn}
            out.append(("burst", rn, rn, None, None, False, None, None))
        if rn == n:
            for name in levels:
                way, extreme, at, *known = state[name]
                mine = known[0 if way > 0 else 1]
                out.append((name, rn, at, extreme, way > 0, True, mine[-1][0] if mine else None, state[slow][4]))
        return state, [(*r[:7], None if r[7] is None else [{"rn": x, "px": y} for x, y in r[7]]) for r in out]

    return step


def turns(inputs: DataFrame, levels: dict[str, float] | None = None, block=None) -> DataFrame:
    """Turns of all levels, bursts and open extremes of numbered bars; the fold's state is a few numbers a level."""
    return ordered_fold(inputs, ("rn", "n", "high", "low", "burst"), None, turn_step(levels or {"fine": FINE, "big": BIG}), TURN_SCHEMA, block=block, warmup=1000)


def _line_at(x) -> Column:
    """The line through the last two bottoms of ``lows`` at row ``x``, or the height of the only one."""
    a, b = F.try_element_at("lows", F.lit(1)), F.try_element_at("lows", F.lit(-1))
    run = F.nullif(b["rn"] - a["rn"], F.lit(0))
    return F.coalesce(a["px"] + (b["px"] - a["px"]) * (x - a["rn"]) / run, a["px"])


def rev_point(bars, chart_sec: int, oi=None, block=None, last_closed=True) -> DataFrame:
    """Fine (0.7 %) and big (2 %) reversal points, exhaustion bursts and the open candidate.

    With ``last_closed`` false the last bar is still forming: it moves no swing, but the candidate is measured at its close.
    """
    inputs = cut_lineage(reversal_inputs(closed_bars(bars, last_closed), chart_sec, oi))
    found = cut_lineage(turns(inputs, block=block).filter("not (open and kind = 'big')"))
    here = inputs.select(*KEYS, "rn", "time", "atr", "trend_up", "open", "high", "low", "close", "vol_ratio").withColumnRenamed("open", "opened").withColumnRenamed("vol_ratio", "vol_now")
    there = inputs.select(*KEYS, c("rn").alias("at_rn"), "vol_ratio", "oi_chg", "rsi14", "at_top", "at_low")
    before = inputs.select(*KEYS, c("rn").alias("before_rn"), c("high").alias("_top_before"), c("rsi14").alias("_rsi_before"))
    now = bars.filter(c("rn") == c("n")).select(*KEYS, c("close").alias("_now"))
    p = found.join(here, [*KEYS, "rn"]).join(there, [*KEYS, "at_rn"]).join(before, [*KEYS, "before_rn"], "left").join(now, list(KEYS))
    kind = F.when(c("open"), "candidate").otherwise(c("kind"))
    fine, burst = c("kind").isin("fine", "candidate"), c("kind") == "burst"
    rising = c("close") >= c("opened")
    p = p.withColumns({"is_top": F.when(burst, ~rising).otherwise(c("is_top")), "price": F.when(burst, F.when(rising, c("low")).otherwise(c("high"))).otherwise(c("price")), "kind": kind})
    top = c("is_top")
    mark = F.when(top, c("at_top")).otherwise(c("at_low"))
    moved = F.coalesce(F.when(top, c("oi_chg") >= OI_TOP).otherwise(c("oi_chg") <= OI_BOTTOM), F.lit(False))
    loud = F.coalesce(c("vol_ratio") >= VOL_STAR, F.lit(False))
    count = sum((x.cast("long") for x in (top & mark["touch"], moved, mark["extreme"])), loud.cast("long"))
    quiet = F.coalesce(c("vol_ratio") < 1.5, F.lit(False)) & mark["stall"]
    tag = F.when(top & quiet, "B").when(~top & loud, "A").otherwise("")
    weaker = F.coalesce((c("price") > c("_top_before")) & (c("rsi14") < c("_rsi_before") - 2), F.lit(False))
    near = F.coalesce(~top & (F.abs(c("price") - _line_at(c("at_rn"))) <= 0.5 * c("atr")), F.lit(False))
    gone = F.when(top, c("price") - c("_now")).otherwise(c("_now") - c("price"))
    back = F.when(c("price") != 0, gone / F.nullif("price", F.lit(0.0))).when(gone > 0, F.lit(float("inf"))).otherwise(0.0)
    return p.select(
        *KEYS, "rn", "time", "kind", "at_rn", "price", "is_top", F.when(fine, count).alias("stars"), F.when(fine & ~c("open"), tag).otherwise("").alias("tag"),
        (fine & ~c("open") & top & weaker).alias("bear_div"), (fine & near).alias("touch_trend"), F.when(top, ~c("trend_up")).otherwise(c("trend_up")).alias("with_trend"),
        F.when(fine | burst, c("vol_ratio")).alias("vol_ratio"), F.when(fine, c("rsi14")).alias("rsi"), F.when(c("open"), (F.lit(FINE) - back) * 100).alias("need_pct"),
    )


def eight_digits(x) -> Column:
    """The number rounded to eight significant digits."""
    v = c(x)
    place = F.lit(7) - F.floor(F.log10(F.abs(F.nullif(v, F.lit(0.0)))))
    unit = F.pow(F.lit(10.0), F.abs(place))
    return F.when(v == 0, 0.0).when(place >= 0, F.round(v * unit) / unit).otherwise(F.round(v / unit) * unit)


def rev_point_report(bars: DataFrame, chart_sec: int, oi=None, last_closed=True, higher=HIGHER) -> DataFrame:
    """One row a key: newest fine and big point, the candidate, the hourly trend, the hour's open interest change, and per
    higher timeframe its newest resistance and support and whether each still stands."""
    points = rev_point(bars, chart_sec, oi, last_closed=last_closed)
    pick = lambda kind, *cols: F.max_by(F.struct(*cols), F.when(c("kind") == kind, c("rn")))
    side = lambda s: F.when(c(f"{s}.is_top"), "top").when(~c(f"{s}.is_top"), "bottom")
    g = points.groupBy(*KEYS).agg(
        pick("fine", "is_top", "price", "stars", "tag").alias("f"), pick("big", "is_top", "price").alias("b"),
        pick("candidate", "is_top", "price", "stars", "need_pct").alias("k"),
    )
    closed = closed_bars(bars, last_closed)
    g = g.join(reversal_inputs(closed, chart_sec, oi).filter(c("rn") == c("n")).select(*KEYS, "trend_up", "oi_chg"), list(KEYS))
    out = g.select(
        *KEYS, side("f").alias("fine_side"), eight_digits("f.price").alias("fine_price"), c("f.stars").alias("fine_stars"), c("f.tag").alias("fine_tag"),
        side("b").alias("big_side"), eight_digits("b.price").alias("big_price"), side("k").alias("candidate_side"), eight_digits("k.price").alias("candidate_price"),
        c("k.stars").alias("candidate_stars"), F.when(c("k.need_pct") > 0, fixed_digits("k.need_pct", 2)).alias("need_pct"),
        F.when(c("trend_up"), "up").otherwise("down").alias("trend_1h"), fixed_digits("oi_chg", 2).alias("oi_chg_1h_pct"),
    )
    for name, minutes in higher:
        if minutes * 60 < chart_sec:
            continue
        levels = htf_levels(closed, minutes, chart_sec)
        one = lambda s, v: F.max(F.when(c("side") == s, c(v)))
        got = levels.groupBy(*KEYS).agg(one("R", "px").alias("r"), one("S", "px").alias("s"), one("R", "active").alias("ra"), one("S", "active").alias("sa"))
        got = got.select(*KEYS, eight_digits("r").alias(f"r_{name}"), eight_digits("s").alias(f"s_{name}"), c("ra").alias(f"r_{name}_active"), c("sa").alias(f"s_{name}_active"))
        out = out.join(got, list(KEYS), "left").fillna(False, [f"r_{name}_active", f"s_{name}_active"])
    return out
