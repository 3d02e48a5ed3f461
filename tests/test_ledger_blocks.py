"""The ledger in many blocks: starts are found at once, not block after block."""

from datetime import datetime, timedelta

import pytest

from barloom.operators import holdings
from barloom.plans import folds

COLUMNS = "id string, symbol string, side string, quantity double, price double, fee double, committed_at timestamp"


def trades(symbol, n, sells=4):
    x, rows = 7, []
    for k in range(n):
        x = (1103515245 * x + 12345) % 2**31
        side = "sell" if (x >> 8) % 100 < sells * 10 else "buy"
        rows.append((f"{k:06d}", symbol, side, float(1 + (x >> 4) % 50), 900.0 + (x % 1000003) / 97.0, (x % 9) * 0.37, datetime(2024, 1, 1) + timedelta(seconds=k * 300)))
    return rows


def walked(rows, locks=False):
    state, held, pnl = dict(holdings.EMPTY), 0.0, 0
    for _, _, side, quantity, price, fee, at in rows:
        day = (at + timedelta(hours=8)).strftime("%Y-%m-%d")
        state, held, delta = holdings.apply_trade(state, held, side == "buy", quantity, price, fee, day, locks)
        pnl += round(holdings.rounded(delta, 4) * 10000)
    return held, state["avg"], pnl / 10000, state["locked"]


def counted(monkeypatch):
    """How often a fold writes states: once, and once more for each round of mends."""
    written, plain = [], folds.cut_lineage

    def cut(df, by=None):
        written.extend([1] if "_out" in df.columns else [])
        return plain(df, by)

    monkeypatch.setattr(folds, "cut_lineage", cut)
    return written


@pytest.mark.parametrize("whole", [False, True])
def test_positions_of_many_blocks_need_one_round(spark, monkeypatch, whole):
    logs = {"AA": trades("AA", 6000), "BB": trades("BB", 3100, 6), "CC": trades("CC", 90, 5)}
    df = spark.createDataFrame([r for rows in logs.values() for r in rows], COLUMNS)
    written = counted(monkeypatch)
    found = holdings.positions(holdings.ledger(df, 128)) if whole else holdings.positions_held(df, None, 128)
    got = {r.symbol: (r.quantity, r.average_cost, r.realized_pnl, r.locked) for r in found.collect()}
    assert got == {symbol: walked(rows) for symbol, rows in logs.items()}
    assert len(written) == 1


def test_locked_shares_over_block_ends(spark):
    rows = trades("600519", 900, 3)
    df = spark.createDataFrame(rows, COLUMNS)
    r = holdings.positions_held(df, None, 64).first()
    assert (r.quantity, r.average_cost, r.realized_pnl, r.locked) == walked(rows, True)
