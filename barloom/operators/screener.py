"""Setups on the last bar of every symbol, and the same rules on every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import fixed_digits, half_up
from barloom.operators.indicators import cutler_stage, sma_stage, upper_median
from barloom.plans.blocks import KEYS, frame

c = F.col
# The setups in reporting order.
PATTERNS = (
    "bullish_alignment",
    "volume_breakout",
    "oversold_reversal",
    "bearish_alignment",
    "volume_breakdown",
    "overbought_reversal",
)
UNIVERSE_BARS = 220
UNIVERSE_LEAST = 30


def tail_bars(bars: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` bars of each key, renumbered from one."""
    skipped = F.greatest(c("n") - limit, F.lit(0))
    return (
        bars.filter(c("rn") > c("n") - limit)
        .withColumn("rn", c("rn") - skipped)
        .withColumn("n", F.least(c("n"), F.lit(limit)))
    )


def screen_columns(bars: DataFrame, block=None) -> DataFrame:
    """Metrics of all six rules per bar, then one score column per rule (null when not met)."""
    f = frame(bars, 201, block=block)
    for w in (20, 50, 200):
        f = sma_stage(f, w, f"sma{w}")
    f = cutler_stage(f, 14, "rsi14")
    before = f.prior(20)
    f = f.add(
        high20=F.max("high").over(before),
        low20=F.min("low").over(before),
        _vols=F.collect_list("volume").over(before),
        prev_close=f.lag("close"),
    )
    f = f.add(volume_median=upper_median(c("_vols")))
    ratio = F.when(c("volume_median") > 0, c("volume") / F.nullif(c("volume_median"), F.lit(0.0))).otherwise(1.0)
    f = f.add(volume_ratio=F.when(c("volume_median").isNotNull(), ratio))
    df = f.rows()

    whole = lambda x: half_up(x, 0)
    capped = lambda x: F.least(F.lit(100.0), whole(x))
    spread = (c("sma20") - c("sma200")) / F.nullif(c("sma200"), F.lit(0.0)) * 100
    out = (c("close") - c("high20")) / F.nullif(c("high20"), F.lit(0.0)) * 100
    under = (c("low20") - c("close")) / F.nullif(c("low20"), F.lit(0.0)) * 100
    body = F.abs(c("close") - c("open"))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    enough_vol = (c("rn") >= 25) & (c("volume_ratio") >= 1.8)
    turned_up = (c("close") > c("open")) | (bottom - c("low") > body * 1.5)
    turned_dn = (c("close") < c("open")) | (c("high") - top > body * 1.5)
    rising = (c("close") > c("sma20")) & (c("sma20") > c("sma50")) & (c("sma50") > c("sma200"))
    falling = (c("close") < c("sma20")) & (c("sma20") < c("sma50")) & (c("sma50") < c("sma200"))
    rules = {
        "bullish_alignment": (rising, 50 + spread * 5),
        "volume_breakout": (enough_vol & (c("close") > c("high20")), 60 + c("volume_ratio") * 10 + out * 5),
        "oversold_reversal": ((c("rn") >= 20) & (c("rsi14") <= 32) & turned_up, (35 - c("rsi14")) * 2 + 60),
        "bearish_alignment": (falling, 50 - spread * 5),
        "volume_breakdown": (enough_vol & (c("close") < c("low20")), 60 + c("volume_ratio") * 10 + under * 5),
        "overbought_reversal": ((c("rn") >= 20) & (c("rsi14") >= 68) & turned_dn, (c("rsi14") - 65) * 2 + 60),
    }
    return df.withColumns({name: F.when(met, capped(score)) for name, (met, score) in rules.items()})


def matches_of(screened: DataFrame, patterns=PATTERNS) -> DataFrame:
    """One row per bar and matched rule."""
    entries = F.array_compact(
        F.array(*[F.when(c(p).isNotNull(), F.struct(F.lit(p).alias("pattern"), c(p).alias("score"))) for p in patterns])
    )
    return screened.withColumn("_m", F.explode(entries)).select(
        *KEYS, "time", "rn", "close", "_m.pattern", "_m.score", "sma20", "sma50", "sma200", "high20", "low20",
        "volume_ratio", "rsi14",
        fixed_digits((c("close") - c("prev_close")) / F.nullif(c("prev_close"), F.lit(0.0)) * 100).alias("change_pct"),
    )


def screen_universe(bars: DataFrame, patterns=PATTERNS, limit=UNIVERSE_BARS, least=UNIVERSE_LEAST) -> DataFrame:
    """All rules on each key's last bar, reading only its last ``limit`` bars, best score first."""
    recent = tail_bars(bars, limit).filter(c("n") >= least)
    last = screen_columns(recent).filter(c("rn") == c("n"))
    return matches_of(last, patterns).drop("rn").orderBy(c("score").desc(), "symbol", "pattern")


def screen_metrics(bars: DataFrame, limit=UNIVERSE_BARS) -> DataFrame:
    """One row per key: the screening numbers of its last bar and the list of rules it meets."""
    last = screen_columns(tail_bars(bars, limit)).filter(c("rn") == c("n"))
    met = F.array_compact(F.array(*[F.when(c(p).isNotNull(), F.lit(p)) for p in PATTERNS]))
    return last.withColumn("matches", F.when(F.size(met) > 0, F.array_join(met, ","))).select(
        *KEYS, "time", "n", "close", "sma20", "sma50", "sma200", "high20", "low20", "volume_ratio", "rsi14", "matches"
    )
