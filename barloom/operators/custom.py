"""User functions over bars: a per-key indicator and a strategy callback."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.backtest import run_strategy
from barloom.plans.blocks import frame


def custom_indicator(bars: DataFrame, name: str, fn, lookback: int, block=None) -> DataFrame:
    """Column ``name`` from ``fn(candles: pandas.DataFrame) -> sequence`` of one number per bar.

    The function states how many earlier bars one value needs and is called on bounded blocks
    carrying that many, never on a whole key. Non-finite numbers become null; a wrong length or type
    fails the job and names the indicator.
    """
    f = frame(bars, lookback, block=block)
    out_columns = [x for x in bars.columns]
    schema = f"{bars.select(*out_columns).schema.simpleString()[7:-1]}, {name}:double"

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        got = list(fn(pdf.drop(columns=["_blk", "_core"])))
        if len(got) != len(pdf):
            raise ValueError(f"indicator {name} returned {len(got)} values for {len(pdf)} bars")
        values = []
        for x in got:
            if x is not None and (isinstance(x, (bool, str)) or not isinstance(x, (int, float)) and not hasattr(x, "__float__")):
                raise TypeError(f"indicator {name} returned a {type(x).__name__}, not a number")
            x = None if x is None else float(x)
            values.append(x if x is not None and math.isfinite(x) else None)
        pdf[name] = pd.Series(values, dtype="float64")
        return pdf.loc[pdf["_core"], [*out_columns, name]]

    grouped = f.df.select(*out_columns, "_blk", "_core").groupBy(*f.parts)
    done = grouped.applyInPandas(apply, schema)
    return done.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def custom_strategy(bars: DataFrame, fn, columns=(), emit="trades", allow_short=False, block=None, **costs) -> DataFrame:
    """Trades of ``fn(bar: dict, position) -> action``; position is None or (side, entry, entry row)."""

    def decide(bar, position):
        action = fn(bar, position)
        if action not in ("enter_long", "exit_long", "enter_short", "exit_short", "hold"):
            raise ValueError(f"strategy returned {action!r}")
        return action

    decide.columns = tuple(columns)
    return run_strategy(bars, decide, emit, allow_short, block, **costs)
