"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bar length in seconds per timeframe name. "1M" is a calendar month and has no
# fixed length.
TIMEFRAME_SECONDS = {
    "1m": 60,
    "3m": 180,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "3d": 259200,
    "1w": 604800,
    "1M": None,
}
LONGEST_MONTH_SECONDS = 31 * 86400


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timeframe_seconds(timeframe="timeframe") -> Column:
    """Fixed bar length in seconds, null for calendar months and unknown names."""
    known = [F.lit(x) for k, v in TIMEFRAME_SECONDS.items() if v for x in (k, v)]
    return F.try_element_at(F.create_map(*known), col(timeframe)).cast("long")


def bar_close_time(timeframe="timeframe", time="time") -> Column:
    """Instant a bar closes; monthly bars close at the next UTC month start."""
    t = col(time)
    month_end = F.date_trunc("month", t) + F.make_ym_interval(F.lit(0), F.lit(1))
    fixed = F.timestamp_seconds(F.unix_micros(t) / 1e6 + timeframe_seconds(timeframe))
    return F.when(col(timeframe) == "1M", month_end).otherwise(fixed)


def half_up(x, digits: int = 2) -> Column:
    """Round half towards positive infinity; a result of minus zero becomes zero."""
    f = float(10**digits)
    return F.floor(col(x) * f + 0.5).cast("double") / f + F.lit(0.0)


def _ties_away(x, digits: int) -> Column:
    """The value, but where it lies exactly between two numbers of so many digits the one away from zero.

    Only dyadic fractions can be exact ties: those whose 2^(digits + 1)-fold is an odd integer.
    """
    v = col(x)
    whole, scale = v * float(2 ** (digits + 1)), float(10**digits)
    tie = (whole == F.floor(whole)) & (F.abs(whole) < 2.0**52) & (F.floor(whole) % 2 != 0)
    return F.when(tie, F.signum(v) * (F.floor(F.abs(v) * scale) + 1) / scale).otherwise(v)


def printed(x, digits: int, even=False) -> Column:
    """Text with a fixed number of digits, rounded from the exact binary value, ties away from zero (or to an ``even``
    last digit, as C's printf does); inf, -inf or nan."""
    v = col(x).cast("double")
    shown = F.call_function("format_number", v if even else _ties_away(v, digits), F.lit("0." + "0" * digits if digits else "0"))
    endless = F.when(v > 0, "inf").otherwise("-inf")
    return F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), endless).otherwise(shown)


def fixed_digits(x, digits: int = 2) -> Column:
    """The number that ``printed`` shows; infinite values stay, minus zero becomes zero."""
    v = col(x).cast("double")
    shown = printed(v, digits).try_cast("double")
    return F.when(F.abs(v) == float("inf"), v).otherwise(shown) + F.lit(0.0)


def scaled_digits(x, digits: int = 2) -> Column:
    """The multiple of 10^-digits that SQL's ``round`` gives: the scaled double is rounded, ties away from zero; infinite
    and NaN values stay, minus zero becomes zero."""
    v, scale = col(x).cast("double"), float(10**digits)
    return F.round(v * scale, 0) / scale + F.lit(0.0)


def finite(x) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ieee_ratio(a, b) -> Column:
    """Division of doubles as the hardware does it: by zero it gives an infinity, and zero by zero NaN."""
    v, w = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when((v == 0) | F.isnan(v), float("nan")).when(v > 0, float("inf")).when(v < 0, float("-inf"))
    return F.when(w == 0, by_zero).otherwise(v / F.nullif(w, F.lit(0.0)))


def price_source(name: str) -> Column:
    """close, open, high, low, hl2, hlc3, ohlc4 or hlcc4 of a candle."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "close": c,
        "open": o,
        "high": h,
        "low": l,
        "hl2": (h + l) / 2,
        "hlc3": (h + l + c) / 3,
        "ohlc4": (o + h + l + c) / 4,
        "hlcc4": (h + l + c + c) / 4,
    }[name]


def millis(time="time") -> Column:
    return F.unix_millis(col(time))


def utc_ntz(time="time") -> Column:
    return col(time).cast("timestamp_ntz")
