"""Zone lives, trees over rows and the zones of a day against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import mtf_zones, zones
from barloom.plans import tree
from barloom.plans.blocks import number_rows

from helpers import candles, lcg_closes, numbered


def test_covers_are_exact_and_short(spark):
    rng = random.Random(1)
    pairs = [(1, 1), (1, 8), (2, 8), (9, 16), (5, 4), (7, 7), (1, 8**6), (3, 3 * 8**6 + 5)] + [(a, a + rng.randrange(-2, 5000)) for a in (rng.randrange(1, 9000) for _ in range(60))]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", tree.cover("a", "b").alias("c")).collect()
    for r in got:
        spans = sorted((n.node * tree.FAN**n.level + 1, (n.node + 1) * tree.FAN**n.level) for n in r.c)
        assert (spans == []) if r.b < r.a else (spans[0][0] == r.a and spans[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:])))
        assert len(spans) <= 2 * (tree.FAN - 1) * tree.LEVELS + 5


def test_newest_over(spark):
    rng = random.Random(2)
    ranges = [("k", a, a + rng.randrange(-1, 300), i) for i, a in enumerate(rng.randrange(1, 900) for _ in range(80))]
    rows = spark.range(1, 1001).selectExpr("'k' k", "id rn")
    df = spark.createDataFrame(ranges, "k string, a long, b long, i long")
    got = {r.rn: (r.any, r.even) for r in tree.newest_over(rows, df, "a", "b", {"any": F.col("i"), "even": F.when(F.col("i") % 2 == 0, F.col("i"))}, ["k"]).collect()}
    for rn in range(1, 1001):
        over = [i for _, a, b, i in ranges if a <= rn <= b]
        assert got[rn] == (max(over, default=None), max((i for i in over if i % 2 == 0), default=None))


def life(bars, zone):
    """(status, visits, place of the bar that ends it) by looking at every later closed bar."""
    visits, was = 0, False
    for k in range(zone["confirmed"], len(bars) - 1):
        b = bars[k]
        if b["close"] > zone["high"] if zone["kind"] == "supply" else b["close"] < zone["low"]:
            return "invalidated", visits, k + 1
        inside = b["high"] >= zone["low"] and b["low"] <= zone["high"]
        visits, was = visits + (inside and not was), inside
    return ("tested" if visits else "fresh"), visits, None


def lives(spark, n_bars, n_zones, seed):
    rng = random.Random(seed)
    b = numbered(spark, lcg_closes(n_bars, seed)).persist()
    bars = [r.asDict() for r in b.orderBy("rn").collect()]
    made = []
    for k in range(n_zones):
        at = rng.randrange(1, n_bars + 1)
        low = bars[at - 1]["close"] * rng.uniform(0.93, 1.07) if k % 3 else bars[rng.randrange(n_bars)][rng.choice(["high", "low", "close"])]
        made.append({"kind": rng.choice(["supply", "demand"]), "low": low, "high": low * rng.uniform(1.0, 1.02), "base_start": k, "base_end": k, "confirmed": at, "atr": 1.0, "displacement": 1.0})
    df = spark.createDataFrame([("AAA", "1h", *z.values()) for z in made], "symbol string, timeframe string, kind string, low double, high double, base_start long, base_end long, confirmed long, atr double, displacement double")
    at = {r["time"]: r["rn"] for r in bars}
    got = {r.base_start: (r.status, r.test_count, at.get(r.invalidated_time)) for r in zones.zone_lifecycle(b, df).collect()}
    return got, {z["base_start"]: life(bars, z) for z in made}


@pytest.mark.parametrize("n_bars, n_zones, seed", [(60, 80, 3), (700, 300, 4)])
def test_zone_lives(spark, n_bars, n_zones, seed):
    got, want = lives(spark, n_bars, n_zones, seed)
    assert got == want


def test_ten_thousand_zones_on_one_key(spark):
    got, want = lives(spark, 1500, 10_000, 5)
    assert got == want and len(got) == 10_000


def pivot(rn, level, atr, slot=0, res=True, wick=1.0):
    label = mtf_zones.slot_label(mtf_zones.SLOTS[slot] * 60)
    return {"rn": rn, "slot": slot, "coarse_rn": rn, "o": int(not res), "atr": atr, "res": res, "level": level, "wick": wick, "prominence": 2.0, "label": label, "weight": 0.5}


def test_all_zones_of_the_day_are_united_at_the_current_range():
    """Two zones that stood apart at a small range are one when a far third is spawned at a large one."""
    near = [pivot(1, 100.0, 1.0), pivot(2, 101.0, 1.0)]
    assert [len(v["zones"]) for v in mtf_zones.day_versions(near, 14)] == [1, 2]
    (*_, last) = mtf_zones.day_versions([*near, pivot(3, 200.0, 5.0)], 14)
    assert [round(z["level"], 2) for z in last["zones"]] == [100.5, 200.0] and last["zones"][0]["wick_n"] == 2 and last["rn"] == 3


def test_repeats_sides_and_the_cap():
    versions = mtf_zones.day_versions([pivot(1, 100.0, 1.0), pivot(4, 100.0, 1.0), pivot(5, 100.0, 1.0, res=False), pivot(5, 100.1, 1.0, slot=1)], None)
    assert [(v["rn"], len(v["zones"])) for v in versions] == [(1, 1), (5, 2)]
    assert versions[-1]["zones"][0]["frames"] == ["M30", "H1"] and not versions[-1]["zones"][1]["res"]
    many = [pivot(k, 100.0 + 10 * k, 1.0, wick=0.01 * k) for k in range(1, 21)]
    assert [z["start_rn"] for z in mtf_zones.day_versions(many, 14)[-1]["zones"]] == list(range(7, 21))
    assert len(mtf_zones.day_versions(many, None)[-1]["zones"]) == 20


def test_a_day_forgets_all_but_the_last_days(spark):
    closes = [100.0 + (7 * k % 23) * (1 + k // 96 % 3) for k in range(96 * 6)]
    from datetime import datetime, timedelta

    rows = [(r.symbol, r.timeframe, datetime(2024, 1, 1) + timedelta(minutes=15 * (i + (96 * 3 if i >= 96 * 4 else 0))), r.open, r.high, r.low, r.close, r.volume) for i, r in enumerate(candles(spark, closes, timeframe="15m").orderBy("time").collect())]
    b = number_rows(spark.createDataFrame(rows, candles(spark, [1.0]).schema))
    zones_ = mtf_zones.mtf_sr(b, 900).filter("kind = 'zone'").select("start_rn").collect()
    assert zones_ and min(r.start_rn for r in zones_) > 96 * 3  # the last three days with bars, whatever lies between
    assert mtf_zones.mtf_sr(b, 900, sessions=1).filter("kind = 'zone' and start_rn <= 480").count() == 0
    forming = mtf_zones.mtf_sr(b, 900, last_closed=False)
    assert forming.filter("kind = 'bar'").count() == len(rows)
