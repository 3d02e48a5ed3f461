"""Candlestick patterns as boolean SQL rules over a bar and its neighbours.

Rule texts use plain names: o h l c for the bar, o1 h1 ... for the bar one back and so on; missing
history is null and a rule touching it is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.indicators import ema_stage, sma_stage
from barloom.plans.blocks import KEYS, fade_rows, frame, number_rows
from barloom.operators.resample import resample_calendar

LAGS = 9

# Derived numbers the rules share, in order of dependence.
PARTS = {
    "body": "abs(c - o)",
    "upper": "h - greatest(o, c)",
    "lower": "least(o, c) - l",
    "span": "h - l",
    "span1": "h1 - l1",
    "swing": "(h - l) / nullif(c1, 0)",
    "wave0": "abs(c - o) / nullif(o, 0)",
    "wave1": "abs(c1 - o1) / nullif(o1, 0)",
    "wave2": "abs(c2 - o2) / nullif(o2, 0)",
    "peak1": "h1 > high_2_5",
    "dip1": "l1 < low_2_5",
}
# (column, rows skipped, rows) of the extremes the rules name.
EXTREMES = [("high", 1, 10), ("high", 2, 5), ("high", 2, 10), ("low", 1, 10), ("low", 2, 5), ("low", 2, 10)]
EXTREMES += [(side, 1, k) for side in ("high", "low") for k in range(1, 6)]

STAR = "abs(c1 - o1) < 0.24 * least(abs(c - o), abs(c2 - o2))"


def _chain(parts) -> str:
    return " and ".join(parts)


def _arch(price: str, up: str, down: str) -> str:
    """Five moves one way, then five back, over ten bars of ``price``."""
    at = lambda k: price if k == 0 else f"{price}{k}"
    rise = [f"{at(k)} {up} {at(k - 1)}" for k in (9, 8, 7, 6)]
    turn = [f"{at(5)} {down}= {at(4)}"]
    fall = [f"{at(k)} {down} {at(k - 1)}" for k in (4, 3, 2, 1)]
    return _chain(rise + turn + fall)


def _island(top: bool) -> str:
    """A gap up to five bars ago, no return into it, and a gap back on this bar."""
    cases = []
    for k in range(1, 6):
        edge = k + 1
        if top:
            cases.append(f"(l{k} > h{edge} * 1.001 and low_1_{k} > h{edge} and h < low_1_{k})")
        else:
            cases.append(f"(h{k} < l{edge} * 0.999 and high_1_{k} < l{edge} and l > high_1_{k})")
    return "(" + " or ".join(f"coalesce({x}, false)" for x in cases) + ")"


# The catalogue order of the fifteen classic patterns and their conditions.
CLASSIC = {
    "hammer": "lower >= 2 * body and swing > 0.005 and l < low_1_10 and upper < 0.5 * body",
    "hanging_man": "lower >= 2 * body and swing > 0.005 and h1 > high_2_10 and upper < 0.5 * body",
    "shooting_star": "upper >= 2 * body and swing > 0.005 and h > high_1_10 and lower < 0.5 * body",
    "dark_cloud_cover": "c1 > o1 and wave1 > 0.003 and o > c and o > c1 and c > o1 and c < (o1 + c1) / 2 and peak1",
    "piercing_line": "c1 < o1 and wave1 > 0.003 and o < c and o < c1 and c < o1 and c > (o1 + c1) / 2 and dip1",
    "flat_top": "abs(h - h1) / nullif(h1, 0) <= 0.000015 and peak1 and h1 > greatest(o1, c1) and upper > 0",
    "flat_bottom": "abs(l - l1) / nullif(l1, 0) <= 0.000015 and dip1 and l1 < least(o1, c1) and lower > 0",
    "bullish_engulfing": "o1 > c1 and c > o and c > o1 and o < c1 and wave0 > 0.005 and l < l1",
    "bearish_engulfing": "o1 < c1 and c < o and c < o1 and o > c1 and wave0 > 0.005 and h > h1",
    "morning_star": f"{STAR} and c2 < o2 and c > o and c > c2 and h1 < least(c, o2) and l1 < least(l, l2) and dip1",
    "evening_star": f"{STAR} and c2 > o2 and c < o and c < c2 and h1 > greatest(h2, h) and l1 > greatest(c, o2) and peak1",
    "three_rising": "c > o and c1 > o1 and c2 > o2 and c > c1 and c1 > c2 and least(wave0, wave1, wave2) > 0.003",
    "three_falling": "c < o and c1 < o1 and c2 < o2 and c < c1 and c1 < c2 and least(wave0, wave1, wave2) > 0.003",
    "top_fractal": "h1 > greatest(h2, h) and h1 > high_2_10 and c < c1 and o1 > o2 and l2 < l1 and l1 > l",
    "bottom_fractal": "l1 < least(l2, l) and l1 < low_2_10 and c > h1 and h2 > h1 and h > h1",
}
# The nineteen further patterns, same form.
FURTHER = {
    "rounding_top": f"{_arch('h', '<', '>')} and {_arch('c', '<', '>')} and c <= c9 and (h5 - least(l, l9)) / nullif(c5, 0) >= 0.005",
    "rounding_bottom": f"{_arch('l', '>', '<')} and {_arch('c', '>', '<')} and c >= c9 and (greatest(h, h9) - l5) / nullif(c5, 0) >= 0.005",
    "gap_up": "l > h1 * 1.001",
    "gap_down": "h < l1 * 0.999",
    "island_top": _island(True),
    "island_bottom": _island(False),
    "gravestone_low": "l < low_1_10 and span > 0 and upper >= 0.65 * span and body <= 0.15 * span and lower <= 0.15 * span and swing > 0.005",
    "inverted_hammer": "l < low_1_10 and upper >= 2 * body and body > 0 and lower < 0.5 * body and swing > 0.005",
    "outside_bull": "c > o and dip1 and h > h1 and l < l1 and wave0 > 0.005",
    "outside_bear": "c < o and peak1 and h > h1 and l < l1 and wave0 > 0.005",
    "harami_bull": "dip1 and c1 < o1 and wave1 > 0.005 and c > o and h < h1 and l > l1",
    "harami_bear": "peak1 and c1 > o1 and wave1 > 0.005 and c < o and h < h1 and l > l1",
    "key_reversal_bear": "h > high_1_10 and c1 > o1 and o > h1 and c < c1 and c < l1",
    "key_reversal_bull": "l < low_1_10 and c1 < o1 and o < l1 and c > c1 and c > h1",
    "exhaustion_bear": "c1 > o1 and wave1 > 0.005 and peak1 and o > h1 and c < o and c - l <= 0.25 * span and wave0 > 0.005",
    "exhaustion_bull": "c1 < o1 and wave1 > 0.005 and dip1 and o < l1 and c > o and h - c <= 0.25 * span and wave0 > 0.005",
    "two_bar_bull": "dip1 and c1 < o1 and c1 - l1 <= 0.2 * span1 and wave1 > 0.005 and c > o and h - c <= 0.2 * span and c > o1 and wave0 > 0.005",
    "two_bar_bear": "peak1 and c1 > o1 and h1 - c1 <= 0.2 * span1 and wave1 > 0.005 and c < o and c - l <= 0.2 * span and c < o1 and wave0 > 0.005",
    "gravestone_high": "h > high_1_10 and span > 0 and upper >= 0.65 * span and body <= 0.15 * span and lower <= 0.15 * span and swing > 0.005",
}
ALL_PATTERNS = {**CLASSIC, **FURTHER}

SHORT = {"open": "o", "high": "h", "low": "l", "close": "c"}


def candle_patterns(bars: DataFrame, rules=None, block=None) -> DataFrame:
    """One boolean column per rule."""
    rules = rules or ALL_PATTERNS
    f = frame(bars, 12, block=block)
    cols = {s: F.col(long) for long, s in SHORT.items()}
    for k in range(1, LAGS + 1):
        cols |= {f"{s}{k}": f.lag(long, k) for long, s in SHORT.items()}
    pick = {"high": F.max, "low": F.min}
    for side, skip, rows in EXTREMES:
        full = F.col("rn") >= skip + rows
        cols[f"{side}_{skip}_{rows}"] = F.when(full, pick[side](side).over(f.prior(rows, skip - 1)))
    scratch = [*cols, *PARTS]
    f = f.add(**cols)
    for name, text in PARTS.items():
        f = f.add(**{name: F.expr(text)})
    f = f.add(**{name: F.coalesce(F.expr(text), F.lit(False)) for name, text in rules.items()})
    return f.rows().drop(*scratch)


def pattern_hits(flagged: DataFrame, rules=None) -> DataFrame:
    """One row per bar and matched pattern, in catalogue order."""
    rules = list(rules or ALL_PATTERNS)
    flags = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("pattern"), F.col(n).alias("on")) for i, n in enumerate(rules)])
    hit = F.explode(F.filter(flags, lambda x: x["on"]))
    return flagged.withColumn("hit", hit).select(*KEYS, "time", "rn", "hit.position", "hit.pattern")


# ---- patterns on coarser candles with a trend filter ---------------------------------------

# Trend before a two-candle pattern compares the averages 2 and 3 candles back; before a
# three-candle pattern those 3 and 4 back.
UP2, DOWN2 = "ma2 > ma3", "ma2 < ma3"
UP3, DOWN3 = "ma3 > ma4", "ma3 < ma4"
# The nineteen rules in catalogue order. The last candle is the confirming one.
TREND_PATTERNS = {
    "evening_star": f"c2 > o2 and c2 - o2 > 10 * abs(c1 - o1) and o - c > 10 * abs(c1 - o1) and c < (o2 + c2) / 2 and o < c1 and {UP3}",
    "morning_star": f"c2 < o2 and o2 - c2 > 10 * abs(c1 - o1) and c - o > 10 * abs(c1 - o1) and c > (o2 + c2) / 2 and o > c1 and {DOWN3}",
    "shooting_star": f"h1 - greatest(o1, c1) >= 2 * abs(o1 - c1) and least(c1, o1) - l1 <= 0.1 * abs(o1 - c1) and {UP2} and o > c",
    "hammer": f"h1 - l1 > 3 * abs(o1 - c1) and (least(o1, c1) - l1) / (0.001 + h1 - l1) > 0.6 and {DOWN2} and c > o",
    "inverted_hammer": f"h1 - l1 > 3 * abs(o1 - c1) and (h1 - greatest(o1, c1)) / (0.001 + h1 - l1) > 0.6 and {DOWN2} and c > o",
    "bearish_harami": f"c1 > o1 and o > c and o <= c1 and o1 <= c and o - c < c1 - o1 and {UP2}",
    "bullish_harami": f"o1 > c1 and c > o and c <= o1 and c1 <= o and c - o < o1 - c1 and {DOWN2}",
    "bearish_engulfing": f"c1 > o1 and o > c and o >= c1 and o1 >= c and o - c > c1 - o1 and {UP2}",
    "bullish_engulfing": f"o1 > c1 and c > o and c >= o1 and c1 >= o and c - o > o1 - c1 and {DOWN2}",
    "piercing_line": f"c1 < o1 and o < l1 and c > (o1 + c1) / 2 and c < o1 and {DOWN2}",
    "bullish_belt": "l = o and o < least(l, l1) and o < c and c > (h1 + l1) / 2",
    "bullish_kicker": f"o1 > c1 and o >= o1 and c > o and {DOWN2}",
    "bearish_kicker": f"o1 < c1 and o <= o1 and c <= o and {UP2}",
    "hanging_man": f"h1 - l1 > 3 * abs(o1 - c1) and (least(o1, c1) - l1) / (0.001 + h1 - l1) >= 0.6 and {UP2} and o > c",
    "dark_cloud_cover": f"c1 > o1 and (c1 + o1) / 2 > c and o > c and o > c1 and c > o1 and (o - c) / (0.001 + h - l) > 0.6 and {UP2}",
    "three_inside_up": f"o2 > c2 and c1 > o1 and c1 <= o2 and o1 >= c2 and c1 - o1 < o2 - c2 and c > o and c > c1 and {DOWN3}",
    "three_inside_down": f"c2 > o2 and o1 > c1 and o1 <= c2 and c1 >= o2 and o1 - c1 < c2 - o2 and o > c and c < c1 and {UP3}",
    "three_outside_up": f"o2 > c2 and c1 > o1 and c1 >= o2 and c2 >= o1 and c1 - o1 > o2 - c2 and c > c1 and {DOWN3}",
    "three_outside_down": f"c2 > o2 and o1 > c1 and o1 >= c2 and o2 >= c1 and o1 - c1 > c2 - o2 and c < c1 and {UP3}",
}


def coarse_bars(bars: DataFrame, unit: str) -> DataFrame:
    """Calendar buckets, numbered like candles (``time`` is the bucket start)."""
    out = resample_calendar(bars, unit).withColumnRenamed("bucket", "time")
    seconds = {"D": 86400, "W": 604800, "M": 2678400}.get(unit) or int(unit) * 60
    return number_rows(out, chunk=F.floor(F.unix_seconds("time") / (seconds * 4096)))


def htf_patterns(bars: DataFrame, unit="D", length=14, method="SMA", rules=None, block=None) -> DataFrame:
    """Trend-filtered patterns on completed coarse candles."""
    rules = rules or TREND_PATTERNS
    coarse = coarse_bars(bars, unit)
    halo = length + 6 + (fade_rows(1 - 2 / (length + 1)) if method == "EMA" else 0)
    f = frame(coarse, halo, block=block)
    f = ema_stage(f, length, "ma") if method == "EMA" else sma_stage(f, length, "ma")
    cols = {s: F.col(long) for long, s in SHORT.items()}
    for k in range(1, 5):
        cols |= {f"{s}{k}": f.lag(long, k) for long, s in SHORT.items()} | {f"ma{k}": f.lag("ma", k)}
    f = f.add(**cols)
    f = f.add(**{name: F.coalesce(F.expr(text), F.lit(False)) for name, text in rules.items()})
    return f.rows().drop(*cols).filter("not forming")
