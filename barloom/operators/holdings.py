"""Positions from a trade log, marks, currencies and portfolio totals."""

from __future__ import annotations

import math
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c
from barloom.functions.exprs import fixed_digits
from barloom.plans.blocks import number_rows, running
from barloom.plans.folds import ordered_fold, rounded_starts, walked
from barloom.session import cut_lineage
from barloom.sources.text import asset_class

SYMBOL = ("symbol",)
EMPTY = {"avg": 0.0, "locked": 0.0, "day": None}


def shanghai_day(time) -> Column:
    return F.date_format(F.from_utc_timestamp(c(time), "Asia/Shanghai"), "yyyy-MM-dd")


def rounded(x: float, digits: int) -> float:
    """Decimal rounding of the exact binary value, ties away from zero."""
    whole = x * (2 << digits)
    if whole.is_integer() and whole % 2:
        return math.copysign((math.floor(abs(x) * 10**digits) + 1) / 10**digits, x)
    return round(x, digits)


def apply_trade(s, held, buys, qty, price, fee, day, locks):
    """One trade on a position of ``held``; quantities keep 8 digits and money 4 after every trade.

    The state holds what a trade can make it forget: average cost, and what is locked on its day.
    """
    avg, locked, delta = s["avg"], s["locked"], 0.0
    if s["day"] != day:
        locked, lock_day = 0.0, None
    else:
        lock_day = s["day"]
    signed = qty if buys else -qty
    after = held + signed
    if held * signed >= 0 and not (held == 0 and not buys and after == 0):
        # Opening or adding: fees raise what is paid and lower what is received.
        paid = abs(held) * avg + qty * price + (fee if buys else -fee)
        avg = paid / abs(after) if after else 0.0
        if buys and locks:
            locked, lock_day = locked + qty, day
        elif not buys:
            locked, lock_day = 0.0, None
    else:
        closed = min(abs(held), qty)
        delta = ((price - avg) if held > 0 else (avg - price)) * closed - fee
        if held > 0:
            free = max(0.0, held - locked)
            locked = max(0.0, locked - (closed - min(closed, free)))
        if after == 0:
            avg, locked, lock_day = 0.0, 0.0 if held < 0 else locked, None
        elif after * held < 0:
            avg = price
            locked, lock_day = (after, day) if after > 0 and locks else (0.0, None)
    qty8 = rounded(after, 8)
    locked = min(max(0.0, rounded(locked, 8)), max(0.0, qty8)) if locks and lock_day == day else 0.0
    return {"avg": rounded(avg, 4), "locked": locked, "day": lock_day}, qty8, delta


LEDGER_INPUTS = ("rn", "n", "id", "held", "buys", "quantity", "price", "fee", "day", "locks")


def _ledger_step(state, values):
    rn, n, trade_id, held, buys, qty, price, fee, day, locks = values
    state, after, delta = apply_trade(state, held, buys, qty, price, fee, day, locks)
    basis = rounded(abs(after) * state["avg"], 4)
    sellable = max(0.0, after - state["locked"])
    return state, [(rn, rn == n, trade_id, after, state["avg"], basis, delta, state["locked"], sellable, day)]


LEDGER_SCHEMA = (
    "rn long, newest boolean, trade_id string, quantity double, average_cost double, cost_basis double, "
    "pnl_delta double, locked double, sellable double, trade_day string"
)


def _starts(exact: DataFrame) -> DataFrame:
    """Average cost at block starts, from the trades that change it as ``apply_trade`` does."""
    held, signed = c("held"), F.when(c("buys"), c("quantity")).otherwise(-c("quantity"))
    after = held + signed
    adds = (held * signed >= 0) & ~((held == 0) & ~c("buys") & (after == 0))
    flips, none = after * held < 0, F.lit(0.0)
    term = lambda added, flipped, empty: F.when(adds & (after != 0), added).when(~adds & flips, flipped).when(after == 0, empty)
    fee = F.when(c("buys"), c("fee")).otherwise(-c("fee"))
    terms = (term(F.abs(held), none, none), term(c("quantity") * c("price"), c("price"), none), term(fee, none, none), term(F.abs(after), F.lit(1.0), F.lit(1.0)))
    starts = rounded_starts(exact, terms, rounded, 4, SYMBOL)
    state = F.concat(F.lit('{"avg": '), c("y").cast("string"), F.lit(', "locked": 0.0, "day": null}'))
    return starts.select(*SYMBOL, "_blk", F.when(c("_blk") > 0, state).alias("_state"))


def _numbered(trades: DataFrame, block) -> DataFrame:
    """Trades in their order, with what is held before each."""
    kind = asset_class("symbol")
    buys = c("side").isin("buy", "long")
    df = trades.withColumns(
        {
            "day": shanghai_day("committed_at"), "buys": buys, "fee": F.coalesce("fee", F.lit(0.0)),
            "locks": (kind["asset_class"] == "equity") & (kind["currency"] == "CNY"), "_signed": F.when(buys, c("quantity")).otherwise(-c("quantity")),
        }
    )
    numbered = number_rows(df, SYMBOL, ("committed_at", "id"), F.floor(F.unix_seconds("committed_at") / 86400))
    numbered = cut_lineage(numbered)  # what follows reads it twice
    return running(numbered, {"_sum": ("sum", "_signed")}, SYMBOL, block).withColumn("held", F.round(c("_sum") - c("_signed"), 8) + F.lit(0.0))


def ledger(trades: DataFrame, block=None) -> DataFrame:
    """Position after every committed trade. Columns: id, symbol, side, quantity, price, fee, committed_at.

    Trades are read in (committed_at, id) order. Quantities and realised profit are running sums; only the average
    cost is folded, from starts that ``rounded_starts`` finds.
    """
    rows = ordered_fold(_numbered(trades, block), LEDGER_INPUTS, EMPTY, _ledger_step, LEDGER_SCHEMA, SYMBOL, block=block, guess=_starts)
    # Rounding after each addition adds rounded numbers, as every earlier total has four digits already.
    rows = running(rows, {"_pnl": ("sum", fixed_digits("pnl_delta", 4))}, SYMBOL, block)
    return rows.withColumn("realized_pnl", fixed_digits("_pnl", 4)).drop("_pnl")


def positions(ledger_rows: DataFrame) -> DataFrame:
    """The newest state of each symbol with its class and currency."""
    kind = asset_class("symbol")
    return ledger_rows.filter("newest").select(
        "symbol", kind["asset_class"].alias("asset_class"), kind["currency"].alias("currency"), "quantity", "average_cost",
        "cost_basis", "realized_pnl", "locked", "sellable", "trade_day",
    )


POSITION_INPUTS = ("rn", "n", "held", "buys", "quantity", "price", "fee", "day", "locks")


def _fold_positions(state, columns):
    """``apply_trade`` over a block; where nothing is locked only the average cost goes from trade to trade."""
    rn, n, held, buys, qty, price, fee, day, locks = columns
    if locks[0]:
        units = 0
        for h, b, x, p, f, t in zip(held.tolist(), buys.tolist(), qty.tolist(), price.tolist(), fee.tolist(), day.tolist()):
            state, last, delta = apply_trade(state, h, b, x, p, f, t, True)
            units += round(rounded(delta, 4) * 10000)
    else:
        signed = np.where(buys, qty, -qty)
        after = held + signed
        adds = (held * signed >= 0) & ~((held == 0) & ~buys & (after == 0))
        flips, grows = ~adds & (after * held < 0), adds & (after != 0)
        moved = adds | flips | (after == 0)
        m, d = np.where(grows, np.abs(held), 0.0), np.where(grows, np.abs(after), 1.0)
        g = np.where(grows, qty * price, np.where(flips, price, 0.0))
        e = np.where(grows, np.where(buys, fee, -fee), 0.0)
        costs = np.array(walked(state["avg"], 4, rounded, m[moved], g[moved], e[moved], d[moved]))
        avg = costs[np.cumsum(moved) - moved][~adds]  # before each closing trade
        h, p = held[~adds], price[~adds]
        delta = np.where(h > 0, p - avg, avg - p) * np.minimum(np.abs(h), qty[~adds]) - fee[~adds]
        scaled = delta * 10000.0
        whole = np.rint(scaled)
        for i in np.flatnonzero(np.abs(scaled - whole) > 0.5 - 1e-6 - 1e-15 * np.abs(scaled)):
            whole[i] = round(rounded(float(delta[i]), 4) * 10000)
        units, last = int(whole.sum()), rounded(float(after[-1]), 8)
        state = {"avg": float(costs[-1]), "locked": 0.0, "day": None}
    cost, locked = state["avg"], state["locked"]
    return state, [(bool(rn[-1] == n[-1]), last, cost, rounded(abs(last) * cost, 4), units, locked, max(0.0, last - locked), day[-1])]


POSITION_SCHEMA = "newest boolean, quantity double, average_cost double, cost_basis double, pnl long, locked double, sellable double, trade_day string"


def positions_held(trades: DataFrame, symbols: list[str] | None, block=None) -> DataFrame:
    """Positions of the wanted symbols only, or of all. A position depends on its own trades alone, so the others are
    left out before they are numbered and folded, and the filter reaches the source of ``trades``.

    The rows are those of ``positions(ledger(trades))``, but the fold gives one row a block and not one a trade.
    """
    numbered = _numbered(holdings_filter(trades, symbols).select("id", "symbol", "side", "quantity", "price", "fee", "committed_at"), block)
    ends = ordered_fold(numbered, POSITION_INPUTS, EMPTY, _fold_positions, POSITION_SCHEMA, SYMBOL, block=block, guess=_starts, whole=True)
    last = ("quantity", "average_cost", "cost_basis", "locked", "sellable", "trade_day")
    rows = ends.groupBy(*SYMBOL).agg(F.max_by(F.struct(*last), "newest").alias("p"), fixed_digits(F.sum("pnl") / 10000, 4).alias("realized_pnl"))
    return positions(rows.select("symbol", "p.*", "realized_pnl", F.lit(True).alias("newest")))


def roll_lock(positions_: DataFrame, now) -> DataFrame:
    """Locks are void once the Shanghai day has changed."""
    stale = c("trade_day").isNull() | (c("trade_day") != shanghai_day(now))
    locked = F.when(stale, 0.0).otherwise(c("locked"))
    return positions_.withColumns({"locked": locked, "sellable": F.greatest(F.lit(0.0), c("quantity") - locked)})


def last_two_closes(bars: DataFrame) -> DataFrame:
    """Latest close and the one before it per symbol, from the two last bars only."""
    return bars.filter(c("rn") >= c("n") - 1).groupBy("symbol").agg(
        F.max(F.when(c("rn") == c("n"), c("close"))).alias("price"),
        F.max(F.when(c("rn") == c("n") - 1, c("close"))).alias("previous_close"),
    )


def mark(positions_: DataFrame, marks: DataFrame) -> DataFrame:
    """Market value, unrealised and today's profit; symbols without a mark keep nulls."""
    df = positions_.join(marks, "symbol", "left")
    q, p, avg, prev = c("quantity"), c("price"), c("average_cost"), c("previous_close")
    gain = F.when(q > 0, p - avg).otherwise(avg - p)
    held = (q != 0) & (avg > 0)
    today = (prev > 0) & (q != 0)
    z = lambda x: F.nullif(x, F.lit(0.0))
    known = p.isNotNull()
    return df.withColumns(
        {
            "market_value": fixed_digits(q * p, 4),
            "unrealized_pnl": F.when(known, F.when(held, fixed_digits(gain * F.abs(q), 4)).otherwise(0.0)),
            "unrealized_pct": F.when(known, F.when(held, fixed_digits(gain / z(avg) * 100)).otherwise(0.0)),
            "today_pnl": F.when(today, fixed_digits((p - prev) * q, 4)),
            "today_pct": F.when(today, fixed_digits((p - prev) / z(prev) * 100)),
        }
    )


def fx_rates(quotes: DataFrame, base="USDT", currencies=("USDT", "USD", "CNY")) -> DataFrame:
    """Rates into the base from USD quotes (ccy, per_usd); an unknown currency counts one to one."""
    per = quotes.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.upper("ccy").alias("k"), c("per_usd").alias("v")))).alias("m"))
    wanted = F.explode(F.array(*[F.lit(x) for x in currencies])).alias("ccy")
    df = per.select("m", wanted)
    quoted = lambda x: F.when(F.try_element_at(c("m"), x) > 0, F.try_element_at(c("m"), x))
    usd = lambda x: F.when(x == "USD", 1.0).otherwise(1.0 / F.coalesce(quoted(x), F.lit(1.0)))
    to_base = F.lit(1.0) if base == "USD" else F.coalesce(quoted(F.lit(base)), F.lit(1.0))
    return df.select(F.lit(base).alias("base"), "ccy", fixed_digits(usd(c("ccy")) * to_base, 8).alias("rate"))


def with_rate(marked: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate by currency, one where it is unknown; the rate table has one row per currency."""
    return marked.join(rates.select(c("ccy").alias("currency"), "rate"), "currency", "left").withColumn("rate", F.coalesce("rate", F.lit(1.0)))


def by_currency(marked: DataFrame) -> DataFrame:
    """Totals per currency. Sums are rounded once at the end, not after every addition."""
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    mv = zero("market_value")
    total = lambda x: fixed_digits(F.sum(x))
    g = marked.groupBy("currency").agg(
        total(mv).alias("market_value"), total(zero("cost_basis")).alias("cost"), total(zero("unrealized_pnl")).alias("unrealized"),
        total(zero("realized_pnl")).alias("realized"), total(zero("today_pnl")).alias("today"),
        total(F.when(mv >= 0, mv).otherwise(0.0)).alias("long_exposure"), total(F.when(mv < 0, -mv).otherwise(0.0)).alias("short_exposure"),
    )
    pct = F.when(c("cost") > 0, fixed_digits(c("unrealized") / F.nullif(c("cost"), F.lit(0.0)) * 100)).otherwise(0.0)
    return g.withColumns({"unrealized_pct": pct, "net_exposure": fixed_digits(c("long_exposure") - c("short_exposure"))})


def nav(marked: DataFrame, rates: DataFrame) -> DataFrame:
    """Portfolio totals in the base currency: one row."""
    df = with_rate(marked, rates)
    in_base = lambda x: F.coalesce(c(x), F.lit(0.0)) * c("rate")
    mv = in_base("market_value")
    g = df.agg(
        F.sum(mv).alias("nav"), F.sum(in_base("cost_basis")).alias("cost"), F.sum(in_base("unrealized_pnl")).alias("unrealized"),
        F.sum(in_base("today_pnl")).alias("today"), F.sum(F.when(mv >= 0, mv).otherwise(0.0)).alias("long_exposure"),
        F.sum(F.when(mv < 0, -mv).otherwise(0.0)).alias("short_exposure"),
    )
    pct = F.when(c("cost") > 0, fixed_digits(c("unrealized") / F.nullif(c("cost"), F.lit(0.0)) * 100)).otherwise(0.0)
    return g.select(
        *[fixed_digits(x).alias(x) for x in ("nav", "cost", "unrealized")], pct.alias("unrealized_pct"),
        *[fixed_digits(x).alias(x) for x in ("today", "long_exposure", "short_exposure")],
        fixed_digits(c("long_exposure") - c("short_exposure")).alias("net_exposure"),
    )


def weights(marked: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Absolute weight in percent against the whole portfolio, or per currency without rates.

    Totals are aggregated first and joined back, so no window holds the whole portfolio.
    """
    size = F.abs(F.coalesce(c("market_value"), F.lit(0.0)))
    if rates is not None:
        df = with_rate(marked, rates).withColumn("_size", size * c("rate"))
        df = df.crossJoin(df.agg(F.sum("_size").alias("_all")))  # one total row
    else:
        df = marked.withColumn("_size", size)
        df = df.join(df.groupBy("currency").agg(F.sum("_size").alias("_all")), "currency")
    share = F.when(c("_all") > 0, fixed_digits(c("_size") / F.nullif(c("_all"), F.lit(0.0)) * 100)).otherwise(0.0)
    return df.withColumn("weight_pct", share).drop("_size", "_all")


def top_name(weighted: DataFrame) -> DataFrame:
    """The heaviest position; the alphabetically first symbol wins a tie."""
    return weighted.agg(F.max("weight_pct").alias("max_weight_pct"), F.min_by("symbol", F.struct(-c("weight_pct"), "symbol")).alias("max_weight_symbol"))


def staged_status(actions: DataFrame) -> DataFrame:
    """Current status per trade from an append-only action log (id, status, at)."""
    return actions.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.min("at").alias("staged_at"), F.max("at").alias("changed_at"))


def list_staged(actions: DataFrame, status="staged") -> DataFrame:
    df = staged_status(actions)
    return (df if status is None else df.filter(c("status") == status)).orderBy(c("staged_at").desc(), "id")


def holdings_filter(rows: DataFrame, symbols) -> DataFrame:
    return rows.filter(F.upper("symbol").isin(*[s.upper() for s in symbols])) if symbols else rows
