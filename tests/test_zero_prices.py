"""Prices of zero and exact ties: derived ratios and what is read from them agree with the SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from barloom.functions import exprs
from barloom.operators import positioning, structure
from barloom.sources import bars, text

QUERIES = ("crowd_vs_whale", "deriv_at_bar", "deriv_history_bars", "deriv_index_lag_variant", "deriv_okx_variant", "nearest_row",
           "position_readings", "posture", "src_quote_text", "swing_labels", "swing_trend")
ZERO = 33  # the SQL of crowd_vs_whale stops at bars that open at zero and close near their high


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three days of events of two kinds; some bars open, close or lie at zero."""
    folder = str(tmp_path_factory.mktemp("zero"))
    values = "CASE WHEN k % 149 = {zero} THEN 0.0 ELSE round((k * 7919) % 1009 / 7.3 + 0.31, 2) END".format(zero=ZERO)
    duckdb.sql(f"""COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k * 97) AS ts, k % 13 AS user_id, CASE WHEN k % 2 = 0 THEN 'view' ELSE 'click' END AS event_type,
      ({values})::DOUBLE AS value, '' AS props FROM range(2600) t(k)) TO '{folder}/events.parquet'""")
    yield folder
    bars.release_bars()


@pytest.mark.parametrize("name", QUERIES)
def test_zero_prices_agree_with_the_sql(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet'")
    df = entry.queries()[name](spark, events)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    assert compare.canonical(df.columns, [tuple(r) for r in df.collect()]) == compare.canonical(columns, cur.fetchall())


def test_ratio_by_zero(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (1.0, 4.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(exprs.ieee_ratio("a", "b")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, None, 0.25]


def test_numbers_are_printed_with_either_rule_of_ties(spark):
    df = spark.createDataFrame([(246.125,), (math.inf,), (-math.inf,), (math.nan,)], "x double")
    got = [tuple(r) for r in df.select(exprs.printed("x", 2), exprs.printed("x", 2, even=True)).collect()]
    assert got == [("246.13", "246.12"), ("inf", "inf"), ("-inf", "-inf"), ("nan", "nan")]
    label = lambda even: df.limit(1).select(F.get(positioning.position_readings("x", even=even), F.lit(0))["label"]).first()[0]
    assert label(False).endswith("246.13") and label(True).endswith("246.12")


def test_trend_is_read_from_labels_only(spark):
    rows = [("a", "1h", "high", 5, "HH"), ("a", "1h", "high", 9, None), ("a", "1h", "low", 7, "HL"), ("b", "1h", "high", 3, None)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, kind string, bar int, label string")
    assert [tuple(r) for r in structure.swing_trend(df).collect()] == [("a", "1h", "HH", "HL", "up")]


def test_zero_fundamentals_are_missing_where_the_source_means_it(spark):
    line = "~".join(["0"] * 50)
    df = spark.createDataFrame([("s", line)], "symbol string, line string")
    assert text.quote_book(df).first().turnover_ratio is None
    kept = text.quote_book(df, zero_missing=("market_cap",)).first()
    assert kept.turnover_ratio == 0.0 and kept.market_cap is None
