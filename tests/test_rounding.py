"""Percent changes rounded by SQL's rule agree with DuckDB's round."""

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.catalog.positioning import pct
from barloom.functions import exprs
from barloom.operators import positioning


def changes(df, rule):
    return df.select("k", positioning.pct_change("now", "past", rounded=rule).alias("p"))


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    """Prices whose changes lie next to a tie."""
    at = f"{tmp_path_factory.mktemp('pairs')}/pairs.parquet"
    duckdb.sql(f"COPY (SELECT k, 100 + k * 0.01::DOUBLE + 0.005::DOUBLE AS now, (100 - k % 3 * 50)::DOUBLE AS past FROM range(4000) t(k)) TO '{at}'")
    return spark.read.parquet(at), duckdb.sql(f"SELECT k, {pct('now', 'past')} AS p FROM '{at}' ORDER BY k").fetchall()


def test_changes_are_rounded_as_in_sql(pairs):
    df, want = pairs
    assert [tuple(r) for r in changes(df, exprs.scaled_digits).orderBy("k").collect()] == want
    assert [tuple(r) for r in changes(df, exprs.fixed_digits).orderBy("k").collect()] != want


def test_scaled_value_decides_ties(spark):
    rows = [(1.115,), (-1.115,), (1.005,), (2.5e-3,), (0.49999999999999994,), (1e300,), (float("inf"),), (None,), (-0.001,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(exprs.scaled_digits("x")).collect()]
    assert got == [1.12, -1.12, 1.0, 0.0, 0.5, 1e300, float("inf"), None, 0.0] and str(got[-1]) == "0.0"
    nan = spark.range(1).select(F.isnan(exprs.scaled_digits(F.lit(float("nan"))))).first()[0]
    assert nan
