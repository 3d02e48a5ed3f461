"""Per-bar indicators: numbered candles in, the same rows with new columns out.

Each indicator is a stage on a framed candle table, so that several of them share one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import half_up, price_source
from barloom.plans.blocks import KEYS, Framed, fade_rows, frame, running

c = F.col


def zero() -> Column:
    return F.lit(0.0)


def no() -> Column:
    return F.lit(False)


def seeded(window: int, value) -> Column:
    """``value`` from the bar on which ``window`` bars exist, else null."""
    return F.when(c("rn") >= window, value)


def wilder_rate(period: int) -> float:
    return 1 - 1 / period


def ema_rate(window: int) -> float:
    return 1 - 2 / (window + 1)


# ---- stages -------------------------------------------------------------------------------


def sma_stage(f: Framed, window: int, out: str, source: Column | None = None) -> Framed:
    return f.add(**{out: seeded(window, F.avg(c("close") if source is None else source).over(f.last(window)))})


def wma_stage(f: Framed, window: int, out: str, source: Column | None = None) -> Framed:
    """Weights 1..window, newest heaviest, over one bounded collected frame."""
    held = F.collect_list(c("close") if source is None else source).over(f.last(window))
    ranks = F.sequence(F.lit(1), F.lit(window))
    total = F.aggregate(F.zip_with(held, ranks, lambda x, k: x * k), zero(), lambda a, b: a + b)
    return f.add(**{out: seeded(window, total / (window * (window + 1) / 2))})


def mean_seeded_input(f: Framed, value: Column, period: int, gain: float, first=1) -> Column:
    """Input of a recurrence that starts at the mean of its first ``period`` values.

    ``first`` is the row (or row column) holding the first of these values.
    """
    age = c("rn") - first + 1
    seed = F.avg(value).over(f.last(period))
    return F.when(age < period, zero()).when(age == period, seed).otherwise(value * gain)


def ema_stage(f: Framed, window: int, out: str, source: Column | None = None, first: int = 1) -> Framed:
    value = c("close") if source is None else source
    k = 2 / (window + 1)
    if window == 1:
        return f.add(**{out: seeded(first, value)})
    f = f.scan(**{f"_y_{out}": (1 - k, mean_seeded_input(f, value, window, k, first))})
    return f.add(**{out: seeded(first + window - 1, c(f"_y_{out}"))})


def wilder_stage(f: Framed, value: str, period: int, out: str, first: int = 1) -> Framed:
    if period == 1:
        return f.add(**{out: seeded(first, c(value))})
    f = f.scan(**{f"_y_{out}": (wilder_rate(period), mean_seeded_input(f, c(value), period, 1 / period, first))})
    return f.add(**{out: seeded(first + period - 1, c(f"_y_{out}"))})


def change_stage(f: Framed) -> Framed:
    return f if "_chg" in f.df.columns else f.add(_chg=F.coalesce(c("close") - f.lag("close"), zero()))


def range_stage(f: Framed) -> Framed:
    """True range in ``_tr``; the first bar of a key has only its own span."""
    if "_tr" in f.df.columns:
        return f
    prev = f.lag("close")
    return f.add(_tr=F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)))


def rsis_stage(f: Framed, names: dict, flat_gain_is_zero: bool = False) -> Framed:
    """RSI for several periods (period -> column) in one pass."""
    f = change_stage(f)
    f = f.add(_up=F.greatest(c("_chg"), zero()), _dn=F.greatest(-c("_chg"), zero()))
    rates = {p: wilder_rate(p) if p > 1 else 1e-300 for p in names}
    feed = lambda value, p: mean_seeded_input(f, c(value), p, 1 / p, 2)
    f = f.scan(**{f"_{k}{p}": (rates[p], feed(v, p)) for p in names for k, v in (("gain", "_up"), ("loss", "_dn"))})
    out = {}
    for p, name in names.items():
        gain, loss = c(f"_gain{p}"), c(f"_loss{p}")
        value = F.when(loss == 0, F.lit(100.0))
        if flat_gain_is_zero:
            value = value.when(gain == 0, zero())
        out[name] = seeded(p + 1, value.when(loss > 0, 100 - 100 / (1 + gain / F.nullif(loss, zero()))))
    return f.add(**out)


def rsi_stage(f: Framed, period: int, out: str, flat_gain_is_zero: bool = False) -> Framed:
    return rsis_stage(f, {period: out}, flat_gain_is_zero)


def rsi_rows(*periods) -> int:
    return max(fade_rows(wilder_rate(p)) if p > 1 else 1 for p in periods) + max(periods) + 2


def macd_rows(fast=12, slow=26, signal=9) -> int:
    return fade_rows(ema_rate(slow)) + fade_rows(ema_rate(signal)) + slow + signal


def macd_stage(f: Framed, fast=12, slow=26, signal=9) -> Framed:
    feed = lambda w: (ema_rate(w), mean_seeded_input(f, c("close"), w, 2 / (w + 1)))
    f = f.scan(_fast=feed(fast), _slow=feed(slow))
    f = f.add(macd=seeded(slow, c("_fast") - c("_slow")))
    f = ema_stage(f, signal, "macd_signal", c("macd"), slow)
    return f.add(macd_hist=c("macd") - c("macd_signal"))


def stochastic_stage(f: Framed, k_window=14, k_smooth=3, d_window=3) -> Framed:
    w = f.last(k_window)
    f = f.add(_top=F.max("high").over(w), _low=F.min("low").over(w))
    spread = c("_top") - c("_low")
    raw = F.when(spread == 0, F.lit(50.0)).otherwise((c("close") - c("_low")) / F.nullif(spread, zero()) * 100)
    f = f.add(_raw=seeded(k_window, raw))
    f = f.add(stoch_k=seeded(k_window + k_smooth - 1, F.avg("_raw").over(f.last(k_smooth))))
    return f.add(stoch_d=seeded(k_window + k_smooth + d_window - 2, F.avg("stoch_k").over(f.last(d_window))))


def atr_stage(f: Framed, period: int, out: str) -> Framed:
    return wilder_stage(range_stage(f), "_tr", period, out)


def movement_stage(f: Framed) -> Framed:
    f = range_stage(f)
    up, down = c("high") - f.lag("high"), f.lag("low") - c("low")
    plus, minus = F.when((up > down) & (up > 0), up), F.when((down > up) & (down > 0), down)
    return f.add(_plus=F.coalesce(plus, zero()), _minus=F.coalesce(minus, zero()))


def adx_rows(period=14) -> int:
    return 2 * fade_rows(wilder_rate(period)) + 2 * period + 2


def adx_stage(f: Framed, period=14) -> Framed:
    """ADX with +DI and -DI from Wilder's running sums over the bars after the first."""
    f = movement_stage(f)
    rate = wilder_rate(period)
    specs = {}
    for name in ("_tr", "_plus", "_minus"):
        seed = F.sum(name).over(f.last(period))
        specs[f"{name}_sum"] = (
            rate,
            F.when(c("rn") < period + 1, zero()).when(c("rn") == period + 1, seed).otherwise(c(name)),
        )
    f = f.scan(**specs)
    live = (c("rn") > period) & (c("_tr_sum") > 0)
    f = f.add(
        plus_di=F.when(live, F.try_divide("_plus_sum", "_tr_sum") * 100),
        minus_di=F.when(live, F.try_divide("_minus_sum", "_tr_sum") * 100),
    )
    total = F.nullif(c("plus_di") + c("minus_di"), zero())
    gap = F.abs(c("plus_di") - c("minus_di"))
    f = f.add(_dx=F.when(live, F.coalesce(gap / total * 100, zero())))
    return dx_average(f, period, "adx")


def dx_average(f: Framed, period: int, out: str) -> Framed:
    """Wilder average of ``_dx`` seeded at its ``period``-th defined row.

    A decaying sum of ranges does not return to zero, so ``_dx`` is undefined only on a flat
    stretch at the start. A block opening mid-series seeds inside its halo, which fades.
    """
    f = f.add(_first=F.min(F.when(c("_dx").isNotNull(), c("rn"))).over(f.upto))
    b = F.when(c("_dx").isNotNull(), mean_seeded_input(f, c("_dx"), period, 1 / period, c("_first")))
    f = f.scan(**{f"_y_{out}": (wilder_rate(period), b)})
    defined = c("_dx").isNotNull() & (c("rn") - c("_first") + 1 >= period)
    return f.add(**{out: F.when(defined, c(f"_y_{out}"))})


def adx_pine_stage(f: Framed, period: int, out: str) -> Framed:
    """Variant on Wilder averages that skip the first bar; a zero DI sum divides by one."""
    f = movement_stage(f)
    feed = lambda name: (wilder_rate(period), mean_seeded_input(f, c(name), period, 1 / period, 2))
    f = f.scan(**{f"{name}_avg": feed(name) for name in ("_tr", "_plus", "_minus")})
    ready = c("rn") > period
    live = ready & (c("_tr_avg") > 0)
    plus, minus = (F.when(live, F.try_divide(100 * c(n), c("_tr_avg"))) for n in ("_plus_avg", "_minus_avg"))
    f = f.add(_pdi=plus, _mdi=minus)
    total = c("_pdi") + c("_mdi")
    f = f.add(_dx=F.abs(c("_pdi") - c("_mdi")) / F.when(total == 0, 1.0).otherwise(total))
    f = dx_average(f, period, f"_{out}")
    return f.add(**{out: c(f"_{out}") * 100})


def mfi_stage(f: Framed, period: int, out: str) -> Framed:
    f = f.add(_tp=price_source("hlc3"))
    f = f.add(_tp1=f.lag("_tp"))
    flow = c("_tp") * c("volume")
    w = f.last(period)
    f = f.add(
        _pos=F.sum(F.when(c("_tp") > c("_tp1"), flow).otherwise(zero())).over(w),
        _neg=F.sum(F.when(c("_tp") < c("_tp1"), flow).otherwise(zero())).over(w),
    )
    ratio = 100 - 100 / (1 + c("_pos") / F.nullif(c("_neg"), zero()))
    value = F.when(c("_neg") == 0, F.lit(100.0)).when(c("_pos") == 0, zero()).otherwise(ratio)
    return f.add(**{out: seeded(period + 1, value)})


def bollinger_stage(f: Framed, window=20, mult=2.0) -> Framed:
    w = f.last(window)
    f = f.add(bb_middle=seeded(window, F.avg("close").over(w)), _sd=F.stddev_pop("close").over(w))
    return f.add(bb_upper=c("bb_middle") + mult * c("_sd"), bb_lower=c("bb_middle") - mult * c("_sd"))


def keltner_stage(f: Framed, window=20, mult=1.5) -> Framed:
    f = atr_stage(ema_stage(f, window, "kc_basis"), window, "_kc_atr")
    return f.add(kc_upper=c("kc_basis") + mult * c("_kc_atr"), kc_lower=c("kc_basis") - mult * c("_kc_atr"))


def donchian_stage(f: Framed, window=20) -> Framed:
    w = f.last(window)
    top, low = seeded(window, F.max("high").over(w)), seeded(window, F.min("low").over(w))
    return f.add(dc_upper=top, dc_lower=low, dc_basis=(top + low) / 2)


def cutler_stage(f: Framed, period: int, out: str) -> Framed:
    f = change_stage(f)
    w = f.last(period)
    f = f.add(
        _gain=F.sum(F.greatest(c("_chg"), zero())).over(w),
        _loss=F.sum(F.greatest(-c("_chg"), zero())).over(w),
    )
    value = F.when(c("_loss") <= 0, F.lit(100.0)).otherwise(100 - 100 / (1 + c("_gain") / F.nullif(c("_loss"), zero())))
    return f.add(**{out: seeded(period + 1, value)})


# ---- operators ----------------------------------------------------------------------------


def sma(bars, window=20, source="close", out="sma", block=None) -> DataFrame:
    return sma_stage(frame(bars, window, block=block), window, out, price_source(source)).rows()


def wma(bars, window=60, source="close", out="wma", block=None) -> DataFrame:
    return wma_stage(frame(bars, window, block=block), window, out, price_source(source)).rows()


def ema(bars, window=20, source="close", out="ema", block=None) -> DataFrame:
    """Exponential average seeded with the simple average of the first ``window`` bars."""
    f = frame(bars, fade_rows(ema_rate(window)) + window, block=block)
    return ema_stage(f, window, out, price_source(source)).rows()


def macd(bars, fast=12, slow=26, signal=9, block=None) -> DataFrame:
    """EMA difference, the EMA of its defined part, and the histogram."""
    return macd_stage(frame(bars, macd_rows(fast, slow, signal), block=block), fast, slow, signal).rows()


def rsi(bars, period=14, out="rsi", block=None) -> DataFrame:
    """Wilder RSI; no losses read 100."""
    return rsi_stage(frame(bars, rsi_rows(period), block=block), period, out).rows()


def pine_rsi(bars, period=14, out="pine_rsi", block=None) -> DataFrame:
    """Wilder RSI that also reads 0 when there are no gains."""
    return rsi_stage(frame(bars, rsi_rows(period), block=block), period, out, True).rows()


def cutler_rsi(bars, period=14, out="cutler_rsi", block=None) -> DataFrame:
    """Plain-window RSI over the last ``period`` changes."""
    return cutler_stage(frame(bars, period + 1, block=block), period, out).rows()


def stochastic(bars, k_window=14, k_smooth=3, d_window=3, block=None) -> DataFrame:
    f = frame(bars, k_window + k_smooth + d_window, block=block)
    return stochastic_stage(f, k_window, k_smooth, d_window).rows()


def true_range(bars, out="tr", block=None) -> DataFrame:
    return range_stage(frame(bars, 1, block=block)).add(**{out: c("_tr")}).rows()


def atr(bars, period=14, out="atr", block=None) -> DataFrame:
    """Wilder average of the true range."""
    return atr_stage(frame(bars, fade_rows(wilder_rate(period)) + period + 1, block=block), period, out).rows()


def atr_progressive(bars, period=14, out="atr_progressive", block=None) -> DataFrame:
    """Mean of the ranges so far until ``period`` bars exist, then Wilder's average."""
    f = atr_stage(frame(bars, fade_rows(wilder_rate(period)) + period + 1, block=block), period, "_atr")
    so_far = F.avg("_tr").over(f.last(period))
    return f.add(**{out: F.coalesce(c("_atr"), so_far)}).rows()


def atr_simple(bars, period=14, out="atr_simple", block=None) -> DataFrame:
    """Rolling mean of the true range."""
    f = range_stage(frame(bars, period + 1, block=block))
    return sma_stage(f, period, out, c("_tr")).rows()


def adx(bars, period=14, block=None) -> DataFrame:
    return adx_stage(frame(bars, adx_rows(period), block=block), period).rows()


def adx_pine(bars, period=14, out="adx_pine", block=None) -> DataFrame:
    return adx_pine_stage(frame(bars, adx_rows(period), block=block), period, out).rows()


def mfi(bars, period=14, out="mfi", block=None) -> DataFrame:
    """Money flow index; one-sided flow reads 100 or 0."""
    return mfi_stage(frame(bars, period + 1, block=block), period, out).rows()


def bollinger(bars, window=20, mult=2.0, block=None) -> DataFrame:
    return bollinger_stage(frame(bars, window, block=block), window, mult).rows()


def donchian(bars, window=20, block=None) -> DataFrame:
    return donchian_stage(frame(bars, window, block=block), window).rows()


def keltner(bars, window=20, mult=1.5, block=None) -> DataFrame:
    """EMA plus and minus a multiple of Wilder's ATR over the same length."""
    return keltner_stage(frame(bars, fade_rows(wilder_rate(window)) + window + 1, block=block), window, mult).rows()


def kernel_weights(kernel: str, lookback: int, bandwidth: float, relative: float = 8.0) -> list[float]:
    """Kernel weights for distances 0..lookback."""
    if bandwidth <= 0:
        return [0.0] * (lookback + 1)
    shapes = {
        "Gaussian": lambda u: math.exp(-u * u / 2),
        "Rational Quadratic": lambda u: (1 + u * u / (2 * relative)) ** -relative,
        "Epanechnikov": lambda u: 0.75 * (1 - u * u) if u <= 1 else 0.0,
        "Triangular": lambda u: 1 - u if u <= 1 else 0.0,
        "Quartic": lambda u: 15 / 16 * (1 - u * u) ** 2 if u <= 1 else 0.0,
        "Cosine": lambda u: math.pi / 4 * math.cos(math.pi * u / 2) if u <= 1 else 0.0,
    }
    return [shapes[kernel](d / bandwidth) for d in range(lookback + 1)]


def nadaraya_watson(
    bars, lookback=50, bandwidth=8.0, h_mult=2.0, band_mult=1.5, kernel="Gaussian", source="close", block=None
) -> DataFrame:
    """Trailing kernel regression with weighted absolute-residual bands and turn flags."""
    weights = kernel_weights(kernel, lookback, bandwidth * h_mult)
    total = sum(weights)
    if total == 0:
        raise ValueError("the kernel gives every distance zero weight")
    # Oldest first, to line up with the collected frame.
    w = F.array(*[F.lit(x) for x in reversed(weights)])
    f = frame(bars, lookback + 3, block=block)
    f = f.add(_src=price_source(source))
    f = f.add(_held=F.collect_list("_src").over(f.last(lookback + 1)))
    dot = lambda values, fn: F.aggregate(F.zip_with(values, w, fn), zero(), lambda a, b: a + b)
    full = c("rn") > lookback
    f = f.add(nw=F.when(full, dot(c("_held"), lambda x, k: x * k) / total))
    f = f.add(_res=F.when(full, dot(c("_held"), lambda x, k: F.abs(x - c("nw")) * k) / total))
    f = f.add(nw_upper=c("nw") + c("_res") * band_mult, nw_lower=c("nw") - c("_res") * band_mult)
    p1, p2 = f.lag("nw"), f.lag("nw", 2)
    return f.add(
        turned_bullish=F.coalesce((p1 < p2) & (c("nw") > p1), no()),
        turned_bearish=F.coalesce((p1 > p2) & (c("nw") < p1), no()),
        band_cross_up=F.coalesce((c("_src") > c("nw_upper")) & (f.lag("_src") <= f.lag("nw_upper")), no()),
        band_cross_dn=F.coalesce((c("_src") < c("nw_lower")) & (f.lag("_src") >= f.lag("nw_lower")), no()),
        nw_bullish=F.coalesce(c("nw") > p1, F.lit(True)),
    ).rows()


def vb_pro_read(
    bars, window=20, bb_mult=2.0, kc_mult=1.5, outer=0.8, walk_n=5, walk_k=3, adx_len=14, adx_min=20.0,
    band="bb", tick=1e-10, block=None,
) -> DataFrame:
    """Band position, band walks, squeeze and its release, and mean-reversion re-entries."""
    halo = max(fade_rows(wilder_rate(window)) + window, adx_rows(adx_len)) + walk_n + 3
    f = frame(bars, halo, block=block)
    f = keltner_stage(bollinger_stage(f, window, bb_mult), window, kc_mult)
    f = adx_pine_stage(donchian_stage(f, window), adx_len, "adx_v")
    basis = {"bb": "bb_middle", "kc": "kc_basis", "dc": "dc_basis"}[band]
    f = f.add(vb_upper=c(f"{band}_upper"), vb_lower=c(f"{band}_lower"), vb_basis=c(basis))
    width = F.greatest(c("vb_upper") - c("vb_lower"), F.lit(tick))
    f = f.add(vb_pos=(c("close") - c("vb_lower")) / width, _trend=F.coalesce(c("adx_v") > adx_min, no()))
    hits = lambda cond: F.sum(F.coalesce(cond.cast("int"), F.lit(0))).over(f.last(walk_n))
    walking = c("_trend") & (c("rn") >= walk_n)
    f = f.add(
        walk_up=walking & (hits(c("vb_pos") >= outer) >= walk_k),
        walk_dn=walking & (hits(c("vb_pos") <= 1 - outer) >= walk_k),
        squeeze=F.coalesce((c("bb_upper") < c("kc_upper")) & (c("bb_lower") > c("kc_lower")), no()),
    )
    fired = F.coalesce(f.lag("squeeze"), no()) & ~c("squeeze")
    close, before = c("close"), f.lag("close")
    return f.add(
        fire_up=F.coalesce(fired & (close > c("vb_basis")), no()),
        fire_dn=F.coalesce(fired & (close < c("vb_basis")), no()),
        mr_short=F.coalesce(~c("_trend") & (before > f.lag("vb_upper")) & (close < c("vb_upper")), no()),
        mr_long=F.coalesce(~c("_trend") & (before < f.lag("vb_lower")) & (close > c("vb_lower")), no()),
        walk_up_start=c("walk_up") & ~F.coalesce(f.lag("walk_up"), no()),
        walk_dn_start=c("walk_dn") & ~F.coalesce(f.lag("walk_dn"), no()),
        vb_state=F.when(c("walk_up"), 1).when(c("walk_dn"), -1).otherwise(0),
    ).rows()


def td_count(bars, block=None) -> DataFrame:
    """Consecutive closes above (``td_up``) or below (``td_dn``) the close four bars earlier."""
    f = frame(bars, 4, block=block)
    c4 = f.lag("close", 4)
    df = f.add(up=F.coalesce(c("close") > c4, no()), dn=F.coalesce(c("close") < c4, no())).rows()
    # Position of the last bar that broke each count.
    broke = lambda flag: ("max", F.when(~c(flag), c("rn")))
    df = running(df, {"stop_up": broke("up"), "stop_dn": broke("dn")}, block=block)
    count = lambda flag, stop: F.when(c(flag), c("rn") - F.coalesce(c(stop), F.lit(0))).otherwise(0)
    return df.withColumns({"td_up": count("up", "stop_up"), "td_dn": count("dn", "stop_dn")}).drop(
        "up", "dn", "stop_up", "stop_dn"
    )


def rsi_diff(bars, fast=6, slow=12, block=None) -> DataFrame:
    """Fast minus slow RSI with dominance, momentum and crosses on every bar."""
    f = frame(bars, rsi_rows(fast, slow) + 1, block=block)
    f = rsis_stage(f, {fast: "rsi_fast", slow: "rsi_slow"})
    f = f.add(_diff=c("rsi_fast") - c("rsi_slow"))
    d, prev, r = c("_diff"), f.lag("_diff"), c("rsi_fast")
    pull = F.when(d >= 0, d - prev).otherwise(prev - d)
    f = f.add(
        rsi_diff=half_up("_diff", 2),
        dominance=F.when(d > 0.05, "bullish").when(d < -0.05, "bearish").when(d.isNotNull(), "neutral"),
        momentum=F.when(pull > 0.05, "expanding").when(pull < -0.05, "contracting").when(pull.isNotNull(), "flat"),
        cross=F.when((d > 0) & (prev <= 0), "golden").when((d < 0) & (prev >= 0), "death"),
    )
    golden = F.when(r < 30, "超卖金叉").when(r > 70, "高位金叉").otherwise("金叉")
    death = F.when(r > 70, "超买死叉").when(r < 30, "低位死叉").otherwise("死叉")
    return f.add(cross_tag=F.when(c("cross") == "golden", golden).when(c("cross") == "death", death)).rows()


def at_last(value) -> Column:
    """Aggregate: the value on the key's last bar."""
    return F.max(F.when(c("rn") == c("n"), value))


def rsi_diff_report(bars, fast=6, slow=12, lookback=48, block=None) -> DataFrame:
    """Last-bar reading per key with the newest cross among the last ``lookback`` + 1 bars."""
    df = rsi_diff(bars, fast, slow, block)
    tail = df.filter(c("rn") >= F.greatest(F.lit(2), c("n") - lookback))
    newest = F.max_by(F.struct("cross", "cross_tag", "rn"), F.when(c("cross").isNotNull(), c("rn")))
    out = tail.groupBy(*KEYS).agg(
        at_last(half_up("rsi_fast")).alias("rsi_fast"),
        at_last(half_up("rsi_slow")).alias("rsi_slow"),
        at_last(c("rsi_diff")).alias("rsi_diff"),
        at_last(c("dominance")).alias("dominance"),
        at_last(c("momentum")).alias("momentum"),
        newest.alias("x"),
        F.max("n").alias("bars"),
    )
    ago = F.when(c("x").isNotNull(), c("bars") - c("x.rn"))
    return out.withColumns({"cross": c("x.cross"), "cross_tag": c("x.cross_tag"), "cross_bars_ago": ago}).drop("x", "bars")


def rsi_cum_diff(bars, length=7, low=30.0, high=70.0, block=None) -> DataFrame:
    """Depth below ``low`` (and height above ``high``) summed since RSI last left that zone."""
    f = rsi_stage(frame(bars, rsi_rows(length), block=block), length, "r")
    depth, height = F.greatest(low - c("r"), zero()), F.greatest(c("r") - high, zero())
    df = f.rows()
    outside = lambda inside: ~F.coalesce(inside, no())
    df = running(
        df,
        {"cum_long": ("since", depth, outside(c("r") < low)), "cum_short": ("since", height, outside(c("r") > high))},
        block=block,
    )
    return df.drop("r")


def volume_ratio_tier(bars, period=4, block=None) -> DataFrame:
    """Volume over the mean of the prior ``period`` bars, and its tier."""
    f = frame(bars, period, block=block)
    f = f.add(_m=F.when(c("rn") > period, F.avg("volume").over(f.prior(period))))
    v, m = c("volume"), c("_m")
    from_nothing = F.when(m.isNotNull() & (v > 0), F.lit(float("inf")))
    f = f.add(volume_ratio=F.when(m > 0, v / F.nullif(m, zero())).otherwise(from_nothing))
    r = c("volume_ratio")
    tier = F.when(r.isNull(), "无前值").when(r < 1, "量比<1").when(r < 2, "量比1-2").when(r < 3, "量比2-3").otherwise("量比≥3")
    return f.add(volume_tier=tier).rows()


def upper_median(values: Column) -> Column:
    """Element at position n div 2 of the sorted values."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def volume_spike(bars, prior=288, least=20, recent=24) -> DataFrame:
    """Last-bar volume over the upper median of up to ``prior`` earlier bars, and the recent peak.

    Only each key's last ``prior`` + 1 rows are kept, so the collected list is bounded.
    """
    tail = bars.filter(c("rn") >= c("n") - prior)
    last = c("rn") == c("n")
    near = F.struct(c("volume"), -c("rn"), c("time"))
    return (
        tail.groupBy(*KEYS)
        .agg(
            F.collect_list(F.when(~last, c("volume"))).alias("v"),
            at_last(c("volume")).alias("last"),
            # Earliest bar among equal volumes; rounding the ratio keeps the order of volumes.
            F.collect_list(F.when(c("rn") > c("n") - recent, F.struct("rn", "volume", "time"))).alias("near"),
        )
        .withColumn("med", F.when(F.size("v") >= least, upper_median(c("v"))))
        .withColumn("med", F.when(c("med") > 0, c("med")))
        .withColumn(
            "best",
            F.array_max(
                F.transform("near", lambda x: F.struct(half_up(x["volume"] / c("med"), 1).alias("r"), (-x["rn"]).alias("o"), x["time"].alias("t")))
            ),
        )
        .select(
            *KEYS,
            half_up(c("last") / c("med"), 1).alias("last_ratio"),
            c("best.r").alias("peak_ratio"),
            F.when(c("best.r").isNotNull(), c("best.t")).alias("peak_time"),
        )
    )


def trunc_ema_value(f: Framed, period: int) -> Column:
    """EMA restarted from the close ``2 * period`` bars back, or from the first bar."""
    k = 2 / (period + 1)
    held = F.collect_list("close").over(f.last(2 * period + 1))
    return F.aggregate(
        F.slice(held, 2, 2 * period), F.get(held, F.lit(0)), lambda a, x: x * k + a * (1 - k)
    )


def trunc_ema(bars, period=12, out="trunc_ema", block=None) -> DataFrame:
    f = frame(bars, 2 * period, block=block)
    return f.add(**{out: trunc_ema_value(f, period)}).rows()


def change_pct(bars, block=None) -> DataFrame:
    """Percent change against the previous close, null when that is missing or zero."""
    f = frame(bars, 1, block=block)
    prev = f.lag("close")
    return f.add(change_pct=(c("close") - prev) / F.nullif(prev, zero()) * 100).rows()
