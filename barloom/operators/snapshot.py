"""All dashboard indicators at once: per bar, and as one labelled row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c
from barloom.functions.exprs import fixed_digits, half_up
from barloom.operators.indicators import (
    adx_rows, adx_stage, atr_stage, bollinger_stage, ema_rate, ema_stage, macd_rows, macd_stage, mfi_stage, rsi_rows, rsis_stage,
    seeded, stochastic_stage, wma_stage,
)
from barloom.operators.signals import supertrend
from barloom.operators.sinks import round_series
from barloom.plans.blocks import KEYS, fade_rows, frame, running

# Reported series and their digits.
SERIES = {
    "rsi14": 2, "rsi7": 2, "rsi_cum_diff": 2, "rsi6": 2, "rsi12": 2, "rsi_diff": 2, "stoch_k": 2, "stoch_d": 2, "adx": 2, "plus_di": 2,
    "minus_di": 2, "macd": 4, "macd_signal": 4, "macd_hist": 4, "mfi14": 2, "bb_upper": 4, "bb_middle": 4, "bb_lower": 4,
}


def all_stages(bars: DataFrame, more=False, block=None):
    """Every indicator over one block cut: one shuffle for the whole dashboard."""
    halo = max(rsi_rows(14), adx_rows(14), macd_rows(), fade_rows(ema_rate(20)) + 20, 201)
    f = frame(bars, halo, block=block)
    f = rsis_stage(f, {p: f"rsi{p}" for p in (6, 7, 12, 14)})
    f = f.add(rsi_diff=half_up(c("rsi6") - c("rsi12"), 2))
    f = mfi_stage(macd_stage(adx_stage(stochastic_stage(f), 14)), 14, "mfi14")
    f = bollinger_stage(f, 20, 2.0)
    if more:
        f = ema_stage(atr_stage(f, 14, "atr14"), 20, "ema20")
        f = f.add(**{f"sma{w}": seeded(w, F.avg("close").over(f.last(w))) for w in (20, 50, 200)})
        for w in (60, 100, 200):
            f = wma_stage(f, w, f"wma{w}")
        f = f.add(prev_close=f.lag("close"))
    return f


def regime_series(bars: DataFrame, block=None) -> DataFrame:
    """The eighteen reported series, rounded once here."""
    df = all_stages(bars, block=block).rows()
    depth = F.greatest(30 - c("rsi7"), F.lit(0.0))
    df = running(df, {"rsi_cum_diff": ("since", depth, ~F.coalesce(c("rsi7") < 30, F.lit(False)))}, block=block)
    return df.select(*KEYS, "time", "rn", "n", "open", "high", "low", "close", "volume", *[round_series(k, d).alias(k) for k, d in SERIES.items()])


def _band(value, low, high, words) -> Column:
    v = c(value)
    return F.when(v < low, words[0]).when(v > high, words[2]).when(v.isNotNull(), words[1])


def _sides(names, windows) -> Column:
    """'above 20/50, below 200' over the averages that exist."""
    say = lambda word, cond: F.array_join(F.array_compact(F.array(*[F.when(cond(c(n)), F.lit(str(w))) for n, w in zip(names, windows)])), "/")
    above, below = say("above", lambda v: c("close") >= v), say("below", lambda v: c("close") < v)
    part = lambda word, text: F.when(text != "", F.concat(F.lit(word + " "), text))
    return F.concat_ws(", ", part("above", above), part("below", below))


LAST = {
    "rsi14": 2, "stoch_k": 2, "stoch_d": 2, "adx": 2, "plus_di": 2, "minus_di": 2, "macd": 4, "macd_signal": 4, "macd_hist": 4, "mfi14": 2,
    "atr14": 4, "sma20": 4, "sma50": 4, "sma200": 4, "ema20": 4, "wma60": 4, "wma100": 4, "wma200": 4, "bb_upper": 4, "bb_middle": 4, "bb_lower": 4,
}


def regime_snapshot(bars: DataFrame) -> DataFrame:
    """One row per key: each indicator's last defined value, rounded, labelled from the rounded value."""
    df = all_stages(bars, more=True).rows()
    at_end = lambda x: F.max(F.when(c("rn") == c("n"), c(x)))
    defined = lambda x: F.max_by(c(x), F.when(c(x).isNotNull(), c("rn")))
    g = df.groupBy(*KEYS).agg(
        F.max("n").alias("bars"), F.max("time").alias("last_time"), at_end("close").alias("close"), at_end("prev_close").alias("prev_close"),
        *[fixed_digits(defined(k), d).alias(k) for k, d in LAST.items()],
    )
    trend = supertrend(bars, 60, 4.0)
    st = trend.groupBy(*KEYS).agg(
        fixed_digits(F.max_by("st_value", F.when(c("st_value").isNotNull(), c("rn")))).alias("st_value"),
        F.max_by("st_direction", F.when(c("st_direction").isNotNull(), c("rn"))).alias("st_direction"),
    )
    g = g.join(st, list(KEYS), "left")
    heat = ("oversold", "neutral", "overbought")
    side = F.when(c("macd") > c("macd_signal"), "bullish").otherwise("bearish")
    near = F.abs(c("macd_hist")) < F.abs(c("macd")) * 0.05
    macd_state = F.when(c("macd") == c("macd_signal"), "flat").when(c("macd_signal").isNotNull(), F.when(near, F.concat(side, F.lit(", converging"))).otherwise(side))
    none = lambda text, word: F.when(text == "", word).otherwise(text)
    return g.withColumns(
        {
            "change_pct": fixed_digits((c("close") - c("prev_close")) / F.nullif(c("prev_close"), F.lit(0.0)) * 100),
            "rsi_state": _band("rsi14", 30, 70, heat),
            "stoch_state": _band("stoch_k", 20, 80, heat),
            "adx_state": _band("adx", 20, 25, ("no trend", "developing trend", "trending")),
            "macd_state": macd_state,
            "mfi_state": _band("mfi14", 20, 80, heat),
            "atr_pct": fixed_digits(c("atr14") / F.nullif(c("close"), F.lit(0.0)) * 100),
            "ma_side": none(_sides(("sma20", "sma50", "sma200"), (20, 50, 200)), "no seeded moving averages"),
            "wma_side": none(_sides(("wma60", "wma100", "wma200"), (60, 100, 200)), "no seeded wma"),
            "bb_state": F.when(c("close") > c("bb_upper"), "above upper band").when(c("close") < c("bb_lower"), "below lower band").when(c("bb_upper").isNotNull(), "inside bands"),
        }
    ).drop("prev_close")
