"""Cutting a series into small blocks must not change any result."""

import math

import pytest

from barloom.operators import holdings, backtest, books, indicators, signals, structure
from barloom.plans.blocks import running, runs
from pyspark.sql import functions as F

from helpers import close_to, lcg_closes, numbered, values

N = 400


@pytest.fixture(scope="module")
def bars(spark):
    return numbered(spark, lcg_closes(N)).persist()


@pytest.mark.parametrize(
    "op, columns",
    [
        (lambda b, k: indicators.sma(b, 20, block=k), ("sma",)),
        (lambda b, k: indicators.bollinger(b, 20, block=k), ("bb_upper", "bb_lower")),
        (lambda b, k: indicators.ema(b, 3, block=k), ("ema",)),
        (lambda b, k: indicators.rsi(b, 2, block=k), ("rsi",)),
        (lambda b, k: indicators.td_count(b, block=k), ("td_up", "td_dn")),
        (lambda b, k: indicators.stochastic(b, block=k), ("stoch_k", "stoch_d")),
    ],
)
def test_small_blocks_agree(bars, op, columns):
    whole, cut = values(op(bars, None), *columns), values(op(bars, 37), *columns)
    assert len(whole) == len(cut) == N
    assert all(close_to(x, y) for a, b in zip(whole, cut) for x, y in zip(a, b))


def test_running_and_since(bars):
    df = bars.withColumn("flag", F.col("rn") % 50 == 0)
    out = running(df, {"s": ("sum", "volume"), "m": ("max", "high"), "z": ("since", F.lit(1.0), F.col("flag"))}, block=23)
    rows = values(out, "rn", "s", "m", "z", "volume", "high")
    total, top, since = 0.0, 0.0, 0
    for rn, s, m, z, v, h in rows:
        total, top = total + v, max(top, h)
        since = 0 if rn % 50 == 0 else since + 1
        assert close_to(s, total) and m == top and z == since


def test_runs_cross_blocks(bars):
    got = runs(bars, F.floor((F.col("rn") - 1) / 90), block=16).orderBy("start").select("start", "end").collect()
    assert [tuple(r) for r in got] == [(1, 90), (91, 180), (181, 270), (271, 360), (361, 400)]


@pytest.mark.parametrize(
    "op",
    [
        lambda b, k: signals.supertrend(b, 10, 3.0, block=k),
        lambda b, k: signals.evasive_supertrend(b, 10, block=k),
        lambda b, k: signals.rsi_grid_rows(b, block=k),
        lambda b, k: backtest.bt_donchian(b, emit="equity", block=k).withColumn("equity", F.round("equity", 6)),  # products of blocks
        lambda b, k: books.order_blocks(b, block=k),
    ],
)
def test_folds_in_blocks_agree(bars, op):
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(op(bars, None)) == key(op(bars, 150))


def test_ledger_of_fifty_blocks_settles_soon(spark, monkeypatch):
    from barloom.plans import folds

    rounds, plain = [], folds.cut_lineage
    monkeypatch.setattr(folds, "cut_lineage", lambda df, by=None: (rounds.append(df.columns), plain(df, by))[1])
    log, held = [], 0.0
    for k in range(1000):  # sells now and then, all of it every thirty trades, which no block of twenty lines up with
        sells = k % 30 in (11, 23, 29)
        size = held if k % 30 == 29 else held / 2 if sells else 1.0 + k % 7
        held += -size if sells else size
        log.append((f"{k:04d}", "BTCUSDT", "sell" if sells else "buy", size, 100 + 10 * math.sin(k), 0.1, k))
    df = spark.createDataFrame(log, "id string, symbol string, side string, quantity double, price double, fee double, s long").withColumn("committed_at", F.timestamp_seconds(F.col("s") * 3600))
    whole = sorted(tuple(r) for r in holdings.ledger(df).select("rn", "quantity", "average_cost", "realized_pnl").collect())
    rounds.clear()
    got = sorted(tuple(r) for r in holdings.ledger(df, block=20).select("rn", "quantity", "average_cost", "realized_pnl").collect())
    assert got == whole
    assert sum("_want" not in c and "_state" in c and "_blk" in c and len(c) == 3 for c in rounds) <= 4  # three rounds and the one that finds nothing


def test_prefix_stability(spark):
    closes = lcg_closes(260)
    long, short = numbered(spark, closes), numbered(spark, closes[:200])
    for op, columns in ((lambda b: indicators.macd(b), ("macd", "macd_signal")), (lambda b: signals.supertrend(b, 14, 3.0), ("st_value", "st_direction"))):
        a, b = values(op(long), *columns)[:200], values(op(short), *columns)
        assert all(close_to(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


def test_strict_pivots(spark):
    b = numbered(spark, [float(x) for x in (1, 2, 3, 2, 1, 2, 3, 3, 2, 1, 0.5, 1, 2)])
    kinds = {(r.rn, r.kind) for r in structure.pivots(b, 2, 2).collect()}
    assert kinds == {(r.rn, r.kind) for r in structure.pivots(b, 2, 2, block=4).collect()}
