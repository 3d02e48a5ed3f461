"""Strategy orders paired into trades, bar by bar, for every key at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import half_up
from barloom.operators.indicators import trunc_ema_value
from barloom.plans.blocks import KEYS, frame, running
from barloom.plans.folds import ordered_fold

c = F.col
CAPITAL = 10000.0
FEE = 0.0005
SLIPPAGE = 0.0002
FLAT = {"pos": None, "owed": 1.0}
POSITION_SCHEMA = (
    "rn long, time timestamp, side string, entry_rn long, entry double, price double, before double, factor double, mark double"
)
BASE = ("rn", "n", "time", "open", "high", "low", "close")


def position_step(decide, fee=FEE, slippage=SLIPPAGE, allow_short=False):
    """Fills at the close with slippage, fee on both sides, a forced exit on the last bar.

    ``decide(bar, position)`` returns enter_long, exit_long, enter_short, exit_short or hold; position is None or
    (side, entry price, entry row). When to be in a position does not depend on money: a closed trade multiplies the
    equity by ``factor``, an open one by ``mark`` for now, and ``before`` is the factor of a trade closed a bar ago.
    """

    def gain(side, entry, price):
        return (1 - fee) / entry * (1 if side == "long" else -1) * (price - entry)

    def step(state, values):
        bar = dict(zip((*BASE, *decide.columns), values))
        rn, close, last = bar["rn"], bar["close"], bar["rn"] == bar["n"]
        pos, factor, trade = state["pos"], 1.0, (None, None, None, None)
        action = decide(bar, pos)
        if pos:
            side, entry, since = pos
            up = side == "long"
            leave = ("exit_long", "enter_short") if up and allow_short else ("exit_long",) if up else ("exit_short", "enter_long")
            if action in leave or last:
                price = close * (1 - slippage if up else 1 + slippage)
                factor = 1 + gain(side, entry, price) - (1 - fee) / entry * price * fee
                trade, pos = (side, since, entry, price), None
        if not pos and not last and (action == "enter_long" or (allow_short and action == "enter_short")):
            side = action[6:]
            entry = close * (1 + slippage if side == "long" else 1 - slippage)
            pos = [side, entry, rn] if entry else None
        mark = 1 + gain(pos[0], pos[1], close) if pos else 1.0
        return {"pos": pos, "owed": factor}, [(rn, bar["time"], *trade, state["owed"], factor, mark)]

    return step


def run_strategy(df: DataFrame, decide, emit="trades", allow_short=False, block=None, capital=CAPITAL, fee=FEE, slippage=SLIPPAGE) -> DataFrame:
    """Run a decision function over numbered bars; ``decide.columns`` names the extra inputs it reads.

    The fold keeps the open position only, which it forgets when flat; equity is a running product over blocks.
    """
    step = position_step(decide, fee, slippage, allow_short)
    bars = ordered_fold(df, (*BASE, *decide.columns), FLAT, step, POSITION_SCHEMA, block=block)
    bars = running(bars, {"growth": ("product", "before")}, block=block).withColumn("held", F.lit(capital) * c("growth"))
    if emit != "trades":
        return bars.select(*KEYS, "rn", "time", (c("held") * c("factor") * c("mark")).alias("equity"))
    ratio = F.when(c("side") == "long", 1).otherwise(-1) * (c("price") / c("entry") - 1)
    return bars.filter("side is not null").select(
        *KEYS, "entry_rn", c("rn").alias("exit_rn"), c("time").alias("exit_time"), "side", half_up("entry", 4).alias("entry_price"),
        half_up("price", 4).alias("exit_price"), half_up(c("held") * (c("factor") - 1)).alias("pnl"), half_up((ratio - fee) * 100).alias("return_pct"),
        (c("rn") - c("entry_rn")).alias("holding_bars"),
    )


def ema_cross_orders(bars, fast=12, slow=26, direction="long", block=None) -> DataFrame:
    """Order column from crosses of two restarted EMAs."""
    f = frame(bars, 2 * slow + 1, block=block)
    f = f.add(_f=trunc_ema_value(f, fast), _s=trunc_ema_value(f, slow))
    f1, s1, ready = f.lag("_f"), f.lag("_s"), c("rn") > slow + 1
    golden, death = (f1 <= s1) & (c("_f") > c("_s")), (f1 >= s1) & (c("_f") < c("_s"))
    up = "enter_long" if direction != "short" else "exit_short"
    down = "enter_short" if direction != "long" else "exit_long"
    order = F.when(ready & golden, up).when(ready & death, down).otherwise("hold")
    return f.add(order=order).rows()


def follow_orders():
    def decide(bar, pos):
        return bar["order"]

    decide.columns = ("order",)
    return decide


def bt_dual_ema(bars, fast=12, slow=26, direction="both", emit="trades", block=None) -> DataFrame:
    orders = ema_cross_orders(bars, fast, slow, direction)
    return run_strategy(orders, follow_orders(), emit, direction != "long", block)


def channel_columns(bars, entry=20, leave=10, block=None) -> DataFrame:
    f = frame(bars, entry, block=block)
    full = lambda x: F.when(c("rn") > entry, x)
    return f.add(
        entry_hi=full(F.max("high").over(f.prior(entry))), entry_lo=full(F.min("low").over(f.prior(entry))),
        exit_hi=full(F.max("high").over(f.prior(leave))), exit_lo=full(F.min("low").over(f.prior(leave))),
    ).rows()


def channel_breakout(direction="long"):
    """Enter beyond the long channel, leave beyond the short one, reverse when both break."""
    can = {"long": direction != "short", "short": direction != "long"}

    def decide(bar, pos):
        if bar["entry_hi"] is None:
            return "hold"
        close = bar["close"]
        over, under = close > bar["entry_hi"], close < bar["entry_lo"]
        if pos is None:
            if can["long"] and over:
                return "enter_long"
            return "enter_short" if can["short"] and under else "hold"
        if pos[0] == "long":
            if not close < bar["exit_lo"]:
                return "hold"
            return "enter_short" if can["short"] and under else "exit_long"
        if not close > bar["exit_hi"]:
            return "hold"
        return "enter_long" if can["long"] and over else "exit_short"

    decide.columns = ("entry_hi", "entry_lo", "exit_hi", "exit_lo")
    return decide


def bt_donchian(bars, entry=20, leave=10, direction="both", emit="trades", block=None) -> DataFrame:
    return run_strategy(channel_columns(bars, entry, leave), channel_breakout(direction), emit, direction != "long", block)


def trade_stats(trades: DataFrame, keys=KEYS) -> DataFrame:
    """Win rate, profit factor (99.99 without losses) and trade Sharpe from the rounded trades."""
    pnl, ret = c("pnl"), c("return_pct") / 100
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(pnl > 0).alias("wins"),
        F.count_if(pnl < 0).alias("losses"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("profit"),
        F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("loss"),
        F.avg(ret).alias("mean"),
        F.coalesce(F.stddev_samp(ret), F.lit(0.0)).alias("sd"),
    )
    factor = F.when(c("loss") > 0, c("profit") / F.nullif(c("loss"), F.lit(0.0))).when(c("profit") > 0, 99.99).otherwise(0.0)
    sharpe = F.when(c("sd") > 0, c("mean") / F.nullif(c("sd"), F.lit(0.0)) * F.sqrt(F.least(c("trades"), F.lit(252)))).otherwise(0.0)
    return g.select(
        *keys, "trades", "wins", "losses", half_up(c("wins") / c("trades") * 100).alias("win_rate_pct"),
        half_up(factor).alias("profit_factor"), half_up(sharpe).alias("sharpe"),
    )


def drawdown(equity: DataFrame, numbered=True, capital=CAPITAL, block=None) -> DataFrame:
    """Largest fall from the running peak, the starting capital counting as the first peak."""
    df = running(equity, {"peak": ("max", F.greatest(c("equity"), F.lit(capital)))}, block=block)
    return df.groupBy(*KEYS).agg(
        half_up(F.max((c("peak") - c("equity")) / c("peak")) * 100).alias("max_drawdown_pct"),
        half_up(F.max_by("equity", "rn")).alias("final_equity"),
    )
