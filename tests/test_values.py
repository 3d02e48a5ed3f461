"""Hand values and edge cases."""

import math

from barloom.functions import exprs
from barloom.operators import audit, holdings, indicators, rules, screener
from barloom.plans.asof import asof_join, nearest_join
from pyspark.sql import functions as F

from helpers import close_to, lcg_closes, numbered, values


def test_flat_series(spark):
    b = numbered(spark, [50.0] * 60, spread=0.0)
    assert values(indicators.rsi(b), "rsi")[-1] == (100.0,)
    assert values(indicators.stochastic(b), "stoch_k")[-1] == (50.0,)
    assert values(indicators.adx(b), "adx", "plus_di")[-1] == (None, None)


def test_ema_and_rsi_against_loops(spark):
    closes = lcg_closes(150)
    b = numbered(spark, closes)
    k, want = 2 / 21, [None] * 19 + [sum(closes[:20]) / 20]
    for x in closes[20:]:
        want.append(x * k + want[-1] * (1 - k))
    assert all(close_to(a[0], w) for a, w in zip(values(indicators.ema(b, 20), "ema"), want))
    gain = loss = 0.0
    out = [None]
    for i in range(1, 150):
        d = closes[i] - closes[i - 1]
        up, dn = max(d, 0.0), max(-d, 0.0)
        if i <= 14:
            gain, loss = gain + up / 14, loss + dn / 14
        else:
            gain, loss = (gain * 13 + up) / 14, (loss * 13 + dn) / 14
        out.append(None if i < 14 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
    assert all(close_to(a[0], w) for a, w in zip(values(indicators.rsi(b), "rsi"), out))


def test_rising_series_is_screened(spark):
    b = numbered(spark, [100 * 1.002**i for i in range(220)])
    assert {r.pattern for r in screener.screen_universe(b).collect()} >= {"bullish_alignment"}


def test_asof_and_nearest(spark):
    t = lambda s: F.timestamp_seconds(F.col(s))
    left = spark.createDataFrame([("a", 100), ("a", 250), ("a", 90000), ("b", 5)], "k string, s int").withColumn("t", t("s"))
    right = spark.createDataFrame([("a", 100, 1), ("a", 200, 2), ("b", 9, 3)], "k string, s int, v int").withColumn("rt", t("s")).drop("s")
    got = {(r.k, r.s): r.v for r in asof_join(left, right, ["k"], "t", "rt", {"v": "v"}, bucket_seconds=60).collect()}
    assert got == {("a", 100): 1, ("a", 250): 2, ("a", 90000): 2, ("b", 5): None}
    tol = {(r.k, r.s): r.v for r in asof_join(left, right, ["k"], "t", "rt", {"v": "v"}, 60).collect()}
    assert tol == {("a", 100): 1, ("a", 250): 2, ("a", 90000): None, ("b", 5): None}
    near = {(r.k, r.s): r.v for r in nearest_join(left, right, ["k"], "t", "rt", {"v": "v"}, 10).collect()}
    assert near == {("a", 100): 1, ("a", 250): None, ("a", 90000): None, ("b", 5): 3}


def test_generator_matches_sequential(spark):
    def draws(seed, n):
        a, out, m = seed, [], 0xFFFFFFFF
        for _ in range(n):
            a = (a + 0x6D2B79F5) & m
            t = ((a ^ (a >> 15)) * (a | 1)) & m
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    got = [r[0] for r in spark.range(200).select(audit.uniform_draw(F.col("id"), 42)).collect()]
    assert got == draws(42, 200)


def test_power_numbers():
    assert audit.required_trades(0.05) == 783


def test_lot_and_costs(spark):
    o = spark.createDataFrame([("600519", "buy", 150, 10.0, 0), ("688001", "buy", 150, 10.0, 0), ("600519", "sell", 50, 10.0, 50)], "symbol string, side string, shares long, price double, total_shares long")
    assert [r.reason for r in rules.lot_size(o).orderBy("shares", "symbol").collect()] == [None, "round_lot", "star_minimum"]
    cost = rules.trade_costs(o.filter("side = 'sell'")).first()
    assert (cost.gross, cost.commission, cost.stamp_duty, cost.total_fees) == (500.0, 5.0, 0.25, 5.26) or math.isclose(cost.total_fees, 5.26)


def test_ledger_average_cost(spark):
    log = spark.createDataFrame(
        [("1", "BTCUSDT", "buy", 1.0, 100.0, 1.0, "2024-01-01 00:00:00"), ("2", "BTCUSDT", "buy", 1.0, 110.0, 1.0, "2024-01-02 00:00:00"), ("3", "BTCUSDT", "sell", 1.5, 120.0, 0.5, "2024-01-03 00:00:00")],
        "id string, symbol string, side string, quantity double, price double, fee double, at string",
    ).withColumn("committed_at", F.to_timestamp("at"))
    p = holdings.positions(holdings.ledger(log)).first()
    assert (p.quantity, p.average_cost, p.realized_pnl) == (0.5, 106.0, 20.5)


def test_same_day_shares_are_locked(spark):
    log = spark.createDataFrame([("1", "sh600519", "buy", 200.0, 10.0, 0.0, "2024-01-02 02:00:00"), ("2", "sh600519", "buy", 100.0, 10.0, 0.0, "2024-01-03 02:00:00")], "id string, symbol string, side string, quantity double, price double, fee double, at string").withColumn("committed_at", F.to_timestamp("at"))
    p = holdings.positions(holdings.ledger(log)).first()
    assert (p.quantity, p.locked, p.sellable) == (300.0, 100.0, 200.0)


def test_fixed_digits_round_the_exact_value_ties_away(spark):
    cases = [(1.005, 2, "1.00"), (2.675, 2, "2.67"), (0.125, 2, "0.13"), (-0.125, 2, "-0.13"), (0.03125, 4, "0.0313"), (0.5, 0, "1"), (2.5, 0, "3"), (1e20, 2, "100000000000000000000.00"), (1.0049999999999999, 2, "1.00")]
    for x, d, text in cases:
        row = spark.createDataFrame([(x,)], "x double").select(exprs.printed("x", d).alias("t"), exprs.fixed_digits("x", d).alias("v")).first()
        assert row.t == text and row.v == float(text), (x, d, row)
        assert holdings.rounded(x, d) == float(text)
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (-0.001,)], "x double").select(exprs.fixed_digits("x", 2)).collect()
    assert odd[0][0] == float("inf") and math.isnan(odd[1][0]) and odd[2][0] is None and str(odd[3][0]) == "0.0"


def test_wanted_positions_are_those_of_the_whole_log(spark):
    from datetime import datetime, timedelta

    sides, start = ("buy", "buy", "sell"), datetime(2024, 1, 1)
    rows = [(f"{k:03d}", s, sides[k % 3], float(1 + k % 4), 10.0 + k, 0.1, start + timedelta(hours=k)) for k in range(40) for s in ("Aa", "bB", "CC")]
    log = spark.createDataFrame(rows, "id string, symbol string, side string, quantity double, price double, fee double, committed_at timestamp")
    rows_of = lambda df: sorted(map(str, df.collect()))
    whole = holdings.positions(holdings.ledger(log))
    assert rows_of(holdings.positions_held(log, ["aA", "BB", "none"])) == rows_of(whole.filter("symbol <> 'CC'"))
    assert rows_of(holdings.positions_held(log, None)) == rows_of(whole)
    assert holdings.positions_held(log, ["none"]).count() == 0
