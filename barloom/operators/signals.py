"""Path-dependent indicators, entry signals and grid positions as ordered folds.

Everything that is a finite or fading function of the bars is computed before the fold; the fold
state holds only what truly depends on the path.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import half_up
from barloom.operators.indicators import adx_rows, adx_stage, atr_stage, rsi_rows, rsi_stage, wilder_rate, wma_stage
from barloom.plans.blocks import KEYS, fade_rows, frame
from barloom.plans.folds import ordered_fold
from barloom.session import cut_lineage

c = F.col

# ---- SuperTrend ------------------------------------------------------------------------------


def trend_step(s, high, low, close, before, atr, factor):
    """Move the ratcheting bands by one bar: (state, value, bullish) with state [lower, upper, down]."""
    mid, width = (high + low) / 2, factor * atr
    lower, upper = mid - width, mid + width
    if s is not None:
        was_lower, was_upper, was_down = s
        if lower <= was_lower and before >= was_lower:
            lower = was_lower
        if upper >= was_upper and before <= was_upper:
            upper = was_upper
        down = close <= upper if was_down else close < lower
    else:
        down = True
    return [lower, upper, down], (upper if down else lower), not down


def _trend_rows(factor):
    def step(state, values):
        rn, time, high, low, close, before, atr = values
        if atr is None:
            return state, [(rn, time, None, None)]
        s, value, bullish = trend_step(state["s"], high, low, close, before, atr, factor)
        return {"s": s}, [(rn, time, value, "bullish" if bullish else "bearish")]

    return step


def supertrend(bars, period=60, factor=4.0, block=None) -> DataFrame:
    f = atr_stage(frame(bars, fade_rows(wilder_rate(period)) + period + 1), period, "atr")
    df = f.add(before=f.lag("close")).rows()
    return ordered_fold(
        df, ("rn", "time", "high", "low", "close", "before", "atr"), {"s": None}, _trend_rows(factor),
        "rn long, time timestamp, st_value double, st_direction string", block=block, warmup=2000,
    )


def evasive_step(state, high, low, close, atr, multiplier, threshold, alpha):
    """SuperTrend whose band steps away from price while price is close to it."""
    band, trend = state
    mid, width = (high + low) / 2, multiplier * atr
    safe = (mid - width) if trend == 1 else (mid + width)
    held = safe if band is None else band
    noisy = abs(close - held) < atr * threshold
    if noisy:
        moved = held - trend * atr * alpha
    else:
        moved = max(safe, held) if trend == 1 else min(safe, held)
    flipped = close < moved if trend == 1 else close > moved
    if flipped:
        trend = -trend
        moved = (mid - width) if trend == 1 else (mid + width)
    return [moved, trend], noisy, flipped


def evasive_supertrend(bars, period=10, multiplier=3.0, threshold=1.0, alpha=0.5, block=None) -> DataFrame:
    f = atr_stage(frame(bars, fade_rows(wilder_rate(period)) + period + 1), period, "atr")

    def step(state, values):
        rn, time, high, low, close, atr = values
        if atr is None:
            return state, [(rn, time, None, None, None, None)]
        s, noisy, flipped = evasive_step(state["s"], high, low, close, atr, multiplier, threshold, alpha)
        signal = ("bull" if s[1] == 1 else "bear") if flipped else None
        return {"s": s}, [(rn, time, s[0], s[1], noisy, signal)]

    return ordered_fold(
        f.rows(), ("rn", "time", "high", "low", "close", "atr"), {"s": [None, 1]}, step,
        "rn long, time timestamp, band double, trend long, noisy boolean, signal string",
        block=block, warmup=2000,
    )


# ---- entry signals ---------------------------------------------------------------------------

# Fixed values of the entry rules.
ADX_MIN = 20
COOLDOWN = 6
PULLBACK_ATR = 0.5
STOP_ATR = 0.25
TARGETS = (1.5, 3.0)
SIGNAL_INPUTS = ("rn", "n", "time", "high", "low", "close", "before", "atr60", "atr14", "wma60", "rsi14", "adx")


def signal_inputs(bars, period=60, block=None) -> DataFrame:
    """All indicators the entry rules read, over one block cut."""
    halo = max(fade_rows(wilder_rate(period)) + period + 2, adx_rows(14), rsi_rows(14), 60)
    f = frame(bars, halo, block=block)
    f = atr_stage(atr_stage(f, period, "atr60"), 14, "atr14")
    f = adx_stage(rsi_stage(wma_stage(f, 60, "wma60"), 14, "rsi14"), 14)
    return f.add(before=f.lag("close")).rows()


def advance(signal, status, high, low):
    """Status after one bar; the stop wins when a bar touches both sides."""
    if status in ("stopped", "target2"):
        return status
    up = signal["side"] == "long"
    worst, best = (low, high) if up else (-high, -low)
    edge = lambda name: signal[name] if up else -signal[name]
    if worst <= edge("stop"):
        return "stopped"
    if best >= edge("target2"):
        return "target2"
    return "target1" if best >= edge("target1") else status


def touched_first_target(signal, high, low):
    return high >= signal["target1"] if signal["side"] == "long" else low <= signal["target1"]


FRESH_SIGNALS = {"trend": None, "side": None, "last": {}, "active": None, "status": "open", "t1": False, "shown": None, "shown_status": "open"}


def new_signal(s, rn, time_us, side, turned, high, low, close, before, band, atr14, wma60, rsi14, adx):
    """The signal this bar gives, or None."""
    up = side == "long"
    sign = 1 if up else -1
    if up:
        dipped = low <= band + PULLBACK_ATR * atr14 and close > before and close > band
        agreed = close > wma60 and rsi14 < 70
    else:
        dipped = high >= band - PULLBACK_ATR * atr14 and close < before and close < band
        agreed = close < wma60 and rsi14 > 30
    if not (turned or dipped) or not agreed or adx < ADX_MIN:
        return None
    stop = band - sign * STOP_ATR * atr14
    risk = sign * (close - stop)
    if not risk > 0 or math.isinf(risk):
        return None
    t1, t2 = (close + sign * k * risk for k in TARGETS)
    return {"rn": rn, "t": time_us, "side": side, "kind": "flip" if turned else "pullback", "entry": close, "stop": stop, "target1": t1, "target2": t2}


def signal_step(factor=4.0, emit="signals", last_closed=False):
    """Step of the one-active-signal machine.

    ``emit`` picks finished signals, one row per bar, or a report: the signals and, after the last confirmed bar, a row of
    that bar's own values, told apart by the first field.
    """
    from datetime import datetime, timedelta

    epoch = datetime(1970, 1, 1)
    as_time = lambda us: epoch + timedelta(microseconds=us)
    as_us = lambda t: round((t.replace(tzinfo=None) - epoch).total_seconds() * 1e6)
    row = lambda g: (g["rn"], as_time(g["t"]), g["side"], g["kind"], g["entry"], g["stop"], g["target1"], g["target2"])

    def step(s, values):
        rn, n, time, high, low, close, before, atr60, atr14, wma60, rsi14, adx = values
        out, end = [], n if last_closed else n - 1
        confirmed = rn <= end
        turned = False
        if confirmed:
            side = None
            if atr60 is not None:
                s["trend"], band, bullish = trend_step(s["trend"], high, low, close, before, atr60, factor)
                side = "long" if bullish else "short"
                turned = s["side"] is not None and s["side"] != side
            s["side"] = side
            fresh = None
            free = s["active"] is None
            if not free:
                a = s["active"]
                s["status"] = advance(a, s["status"], high, low)
                if s["status"] != "stopped" and touched_first_target(a, high, low):
                    s["t1"] = True
                if s["status"] in ("stopped", "target2"):
                    if emit != "rows":
                        out.append((*row(a), s["status"], s["t1"], rn))
                    s["active"], free = None, True
            ready = None not in (side, atr14, wma60, rsi14, adx, before)
            if free and rn > 1 and ready and rn - s["last"].get(side, -COOLDOWN - rn) >= COOLDOWN:
                fresh = new_signal(s, rn, as_us(time), side, turned, high, low, close, before, band, atr14, wma60, rsi14, adx)
            if fresh:
                s["active"], s["status"], s["t1"] = fresh, "open", False
                s["last"][side] = rn
                s["shown"], s["shown_status"] = fresh, "open"
            elif s["shown"]:
                s["shown_status"] = advance(s["shown"], s["shown_status"], high, low)
        if emit == "rows":
            g = s["shown"]
            out.append((rn, time, confirmed, *((g["rn"], g["side"], g["entry"], s["shown_status"]) if g else (None,) * 4)))
        elif rn == end and s["active"]:
            out.append((*row(s["active"]), s["status"], s["t1"], None))
        if emit == "report":
            out = [(False, *o, *(None,) * 4) for o in out]
            if rn == end:
                out.append((True, rn, time, s["side"], *(None,) * 8, close, wma60, rsi14, adx))
        return s, out

    return step


SIGNAL_SCHEMA = (
    "rn long, time timestamp, side string, kind string, entry double, stop double, target1 double, target2 double, "
    "status string, hit_t1 boolean, closed_rn long"
)


def entry_signals(bars, period=60, factor=4.0, last_closed=False, block=None) -> DataFrame:
    """Every signal with its final status; the status changes as later bars arrive."""
    return ordered_fold(
        signal_inputs(bars, period), SIGNAL_INPUTS, FRESH_SIGNALS, signal_step(factor, "signals", last_closed),
        SIGNAL_SCHEMA, block=block, warmup=2000,
    )


def signal_rows(bars, period=60, factor=4.0, last_closed=False, block=None) -> DataFrame:
    """One row per bar: the signal being followed and its status as of that bar."""
    return ordered_fold(
        signal_inputs(bars, period), SIGNAL_INPUTS, FRESH_SIGNALS, signal_step(factor, "rows", last_closed),
        "rn long, time timestamp, confirmed boolean, signal_rn long, side string, entry double, as_of_status string",
        block=block, warmup=2000,
    )


def signal_record(signals: DataFrame, *more) -> DataFrame:
    """Per key: finished signals, first and second targets touched, stops, still active."""
    done = c("status").isin("stopped", "target2")
    return signals.groupBy(*KEYS).agg(
        F.count_if(done).alias("finished"),
        F.count_if(done & c("hit_t1")).alias("hit_t1"),
        F.count_if(c("status") == "target2").alias("hit_t2"),
        F.count_if(c("status") == "stopped").alias("stopped"),
        F.count_if(~done).alias("active"),
        *more,
    )


def signal_report(bars, period=60, factor=4.0, lookback=48) -> DataFrame:
    """Per key at the last confirmed bar: newest recent signal, trend, what stands in the way, record."""
    found = cut_lineage(
        ordered_fold(
            signal_inputs(bars, period), SIGNAL_INPUTS, FRESH_SIGNALS, signal_step(factor, "report"),
            f"now boolean, {SIGNAL_SCHEMA}, close double, wma60 double, rsi14 double, adx double", warmup=2000,
        )
    )
    newest = F.max_by(F.struct("rn", "side", "kind", "entry", "stop", "target1", "target2", "status"), "rn").alias("g")
    record = signal_record(found.filter("not now"), newest)
    df = found.filter("now").select(*KEYS, "rn", "time", c("side").alias("trend"), "close", "wma60", "rsi14", "adx").join(record, list(KEYS), "left")
    df = df.withColumn("bars_ago", c("rn") - c("g.rn"))
    recent = c("bars_ago") <= lookback
    long = c("trend") == "long"
    side_blocked = F.when(long, c("close") <= c("wma60")).otherwise(c("close") >= c("wma60"))
    stretched = F.when(long, c("rsi14") >= 70).otherwise(c("rsi14") <= 30)
    has = c("trend").isNotNull()
    blockers = F.array_compact(
        F.array(
            F.when(has & side_blocked, "wma60"),
            F.when(has & (c("adx") < ADX_MIN), "adx"),
            F.when(has & stretched, "rsi"),
            F.when(c("active") > 0, "active"),
        )
    )
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    return df.select(
        *KEYS, "time", "trend", F.array_join(blockers, ",").alias("blockers"),
        *[F.when(recent, c(f"g.{x}")).alias(x) for x in ("side", "kind", "entry", "stop", "target1", "target2", "status")],
        F.when(recent, c("bars_ago")).alias("bars_ago"),
        *[zero(x) for x in ("finished", "hit_t1", "hit_t2", "stopped", "active")],
    )


# ---- RSI grid --------------------------------------------------------------------------------

GRID = (7, 30.0, 60.0, 10.0)


def mirrored(params=GRID):
    """Short-side thresholds: the long ones reflected around 50."""
    length, low, high, threshold = params
    return length, 100 - high, 100 - low, threshold


def grid_side_step(s, rn, open_, close, rsi, low, high, threshold, short):
    """One bar of one side: orders of the last close fill at this open, then new ones are decided.

    Returns (state, entry fill, closed trade, signal).
    """
    fill = closed = signal = None
    if s["exit"] and s["pos"]:
        closed = (s["pos"][0], s["pos"][1], rn, open_)
        s["pos"] = None
    if s["enter"] and not s["pos"]:
        s["pos"] = [rn, open_]
        fill = open_
    s["enter"] = s["exit"] = False
    depth = 0.0 if rsi is None else (rsi - high if short else low - rsi)
    s["cum"] = s["cum"] + depth if depth > 0 else 0.0
    if rsi is not None:
        if s["pos"] is None:
            if depth > 0 and s["cum"] > threshold:
                s["enter"], signal = True, "entry"
        else:
            losing = close > s["pos"][1] if short else close < s["pos"][1]
            back = rsi <= low if short else rsi >= high
            if back and not losing:
                s["exit"], signal = True, "exit"
    return s, fill, closed, signal


FLAT = {"cum": 0.0, "pos": None, "enter": False, "exit": False}


def _grid_step(params, emit):
    sides = {"long": (params, False), "short": (mirrored(params), True)}

    def step(state, values):
        rn, n, time, open_, close, rsi = values
        row, out = [], []
        for side, ((_, low, high, threshold), short) in sides.items():
            state[side], fill, closed, signal = grid_side_step(state[side], rn, open_, close, rsi, low, high, threshold, short)
            s = state[side]
            shown = -s["cum"] if short and s["cum"] else s["cum"]
            row += [shown, signal, fill, closed[3] if closed else None, s["pos"] is not None, s["pos"][1] if s["pos"] else None]
            if emit != "rows":
                if closed:
                    out.append((side, *closed))
                if rn == n and s["pos"]:
                    out.append((side, *s["pos"], None, None))
        if emit == "report":
            out = [(False, *o, *(None,) * 6) for o in out]
            if rn == n:
                for k, side in enumerate(sides):
                    cum, signal, _, _, _, held = row[6 * k : 6 * k + 6]
                    out.append((True, side, state[side]["pos"][0] if state[side]["pos"] else None, held, rn, None, time, close, rsi, abs(cum), signal, n))
        return state, [(rn, time, rsi, *row)] if emit == "rows" else out

    return step


def _grid(bars, params, emit, schema, block):
    f = rsi_stage(frame(bars, rsi_rows(params[0])), params[0], "rsi")
    return ordered_fold(
        f.rows(), ("rn", "n", "time", "open", "close", "rsi"), {"long": dict(FLAT), "short": dict(FLAT)}, _grid_step(params, emit),
        schema, block=block, warmup=1000,
    )


def rsi_grid(bars, params=GRID, block=None) -> DataFrame:
    """Trades of the cumulative-RSI grid, long and mirrored short; an open position has no exit."""
    schema = "side string, entry_rn long, entry double, exit_rn long, exit double"
    return _grid(bars, params, "trades", schema, block)


def rsi_grid_rows(bars, params=GRID, block=None) -> DataFrame:
    """One row per bar: cumulative depth, order signal, fills and position of both sides."""
    side = "{0}_cum double, {0}_signal string, {0}_entry double, {0}_exit double, {0}_in_pos boolean, {0}_pos_entry double"
    schema = f"rn long, time timestamp, rsi double, {side.format('long')}, {side.format('short')}"
    return _grid(bars, params, "rows", schema, block)


def grid_pct(short, entry, exit_):
    return F.when(short, entry - exit_).otherwise(exit_ - entry) * 100 / F.nullif(entry, F.lit(0.0))


def grid_record(trades: DataFrame) -> DataFrame:
    """Closed trades, winners and mean percent per key and side."""
    pct = grid_pct(c("side") == "short", c("entry"), c("exit"))
    return (
        trades.withColumn("pct", pct)
        .groupBy(*KEYS, "side")
        .agg(F.count("exit").alias("closed"), F.count_if(c("pct") > 0).alias("wins"), half_up(F.avg("pct")).alias("avg_pct"))
    )


def rsi_grid_report(bars, params=GRID) -> DataFrame:
    """Per key and side at the last bar: RSI, depth, pending order, open position and record."""
    schema = "now boolean, side string, entry_rn long, entry double, exit_rn long, exit double, time timestamp, close double, rsi double, cum double, pending string, n long"
    found = cut_lineage(_grid(bars, params, "report", schema, None))
    df = found.filter("now").join(grid_record(found.filter("not now")), [*KEYS, "side"], "left")
    pct = grid_pct(c("side") == "short", c("entry"), c("close"))
    return df.select(
        *KEYS, "side", "time", half_up("rsi").alias("rsi"), half_up("cum").alias("cum"), "pending",
        half_up("entry").alias("entry"), (c("n") - c("entry_rn")).alias("bars_held"), half_up(pct).alias("pnl_pct"),
        F.coalesce("closed", F.lit(0)).alias("closed"), F.coalesce("wins", F.lit(0)).alias("wins"), "avg_pct",
    )
