"""Alert families and the ledger of the run that raised an alert first."""

from helpers import SCHEMA, lcg_closes, numbered
from pyspark.sql import functions as F

from barloom.operators import alerts as A
from barloom.plans.blocks import number_rows

CHEAP = ("kp", "td", "nw")


def rows(df):
    return sorted((r["alert_id"], r["family"]) for r in df.collect())


def test_each_run_raises_what_a_backfill_shows_for_its_last_closed_bar(spark):
    bars = numbered(spark, lcg_closes(140)).cache()
    every = [x for x in rows(A.raise_alerts(bars, 3600, CHEAP, last_closed_only=False))]
    assert {family for _, family in every} == set(CHEAP)
    times = {r["rn"]: r["t"] for r in bars.select("rn", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("t")).collect()}
    for n in (90, 120, 140):
        seen = bars.filter(F.col("rn") <= n).withColumn("n", F.lit(n).cast("long"))
        got = rows(A.raise_alerts(seen, 3600, CHEAP))
        assert got == [x for x in every if x[0].startswith(times[n - 1])]


def test_reversal_and_coarse_alerts_come_from_closed_bars(spark):
    bars = numbered(spark, lcg_closes(400))
    found = A.raise_alerts(bars, 3600, ("rp", "htf"), last_closed_only=False)
    last = bars.agg(F.max("time")).first()[0]
    got = found.groupBy("family").agg(F.max("time").alias("t"), F.count(F.lit(1)).alias("k")).collect()
    assert {r["family"] for r in got} >= {"rp"} and all(r["t"] < last and r["k"] > 0 for r in got)


def test_ledger_keeps_the_first_run_and_counts_repeats_once(spark):
    schema = "symbol string, timeframe string, alert_id string, time timestamp, family string, code string"
    make = lambda *ids: spark.createDataFrame([(s, "1h", i, None, "kp", "kp.x") for s, i in ids], schema)
    ledger, fresh = A.extend_ledger(None, make(("A", "1|x"), ("A", "1|x"), ("B", "1|x")), 1)
    assert fresh.count() == 2
    ledger, fresh = A.extend_ledger(ledger, make(("A", "1|x"), ("A", "2|x")), 2)
    assert [r["alert_id"] for r in fresh.collect()] == ["2|x"]
    ledger, fresh = A.extend_ledger(ledger, make(), 3)
    assert fresh.count() == 0
    assert sorted((r["symbol"], r["alert_id"], r["raised_in"]) for r in ledger.collect()) == [("A", "1|x", 1), ("A", "2|x", 2), ("B", "1|x", 1)]


def test_no_bars_raise_nothing(spark):
    empty = number_rows(spark.createDataFrame([], SCHEMA))
    assert A.raise_alerts(empty, 3600, ("kp", "td")).count() == 0
