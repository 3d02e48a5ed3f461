"""Alerts of six families through one interface, and a ledger of the run that raised each first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators import patterns as P
from barloom.operators import reversals as V
from barloom.plans.blocks import KEYS, frame
from barloom.session import cut_lineage

c = F.col
ID = (*KEYS, "alert_id")


def _flagged(df: DataFrame, flags: dict[str, Column], newest: Column | None = None) -> DataFrame:
    """One row per raised flag of a closed bar; ``newest`` tells the last closed bar."""
    codes = F.array_compact(F.array(*[F.when(on, F.lit(code)) for code, on in flags.items()]))
    closed = df if newest is not None else df.filter(c("rn") < c("n"))
    return closed.select(*KEYS, "time", F.explode(codes).alias("code"), (c("rn") == c("n") - 1 if newest is None else newest).alias("newest"))


def candle_alerts(bars: DataFrame, **_) -> DataFrame:
    """The fifteen classic patterns."""
    return _flagged(P.candle_patterns(bars, P.CLASSIC), {f"kp.{x}": c(x) for x in P.CLASSIC})


def count_alerts(bars: DataFrame, **_) -> DataFrame:
    """The ninth and thirteenth close of a count."""
    return _flagged(I.td_count(bars), {f"td.{s}{k}": c(f"td_{s}") == k for k in (9, 13) for s in ("up", "dn")})


def kernel_alerts(bars: DataFrame, **_) -> DataFrame:
    """Turns of the kernel line and closes that cross its bands."""
    flags = {x: c(x) for x in ("turned_bullish", "turned_bearish", "band_cross_up", "band_cross_dn")}
    flags["trend_changed"] = c("turned_bullish") | c("turned_bearish")
    return _flagged(I.nadaraya_watson(bars), {f"nw.{x}": on for x, on in flags.items()})


def band_alerts(bars: DataFrame, **_) -> DataFrame:
    """Band walks that begin, squeezes that fire and re-entries to the mean."""
    f = frame(I.vb_pro_read(bars), 1)
    begins = lambda x: c(x) & ~F.coalesce(f.lag(x), F.lit(False))
    f = f.add(up_start=begins("walk_up"), dn_start=begins("walk_dn"))
    flags = {"walk_up_start": c("up_start"), "walk_dn_start": c("dn_start"), "fire_up": c("fire_up"), "fire_dn": c("fire_dn"), "mr": c("mr_long") | c("mr_short")}
    return _flagged(f.rows(), {f"vb.{x}": on for x, on in flags.items()})


def coarse_alerts(bars: DataFrame, unit="D", **_) -> DataFrame:
    """The first pattern in catalogue order on each completed coarse candle; ``time`` is the candle's start."""
    done = P.htf_patterns(bars, unit)
    first = F.coalesce(*[F.when(c(x), F.lit(f"htf.{x}")) for x in P.TREND_PATTERNS])
    # The forming candle is left out already, so the newest completed one is the last but one of all.
    return done.withColumn("code", first).filter("code is not null").select(*KEYS, "time", "code", (c("rn") == c("n") - 1).alias("newest"))


def reversal_alerts(bars: DataFrame, chart_sec: int, oi=None, **_) -> DataFrame:
    """Fine and big turns at the bar that confirms them, and every exhaustion bar, however close to the one before."""
    inputs = cut_lineage(V.reversal_inputs(V.closed_bars(bars, False), chart_sec, oi))
    newest = (c("rn") == c("n")).alias("newest")
    found = V.turns(inputs).filter("not open and kind <> 'burst'").select(*KEYS, "rn", "kind")
    turned = found.join(inputs.select(*KEYS, "rn", "n", "time"), [*KEYS, "rn"]).select(*KEYS, "time", F.concat(F.lit("rp."), "kind", F.lit("_confirmed")).alias("code"), newest)
    return turned.unionByName(inputs.filter("burst").select(*KEYS, "time", F.lit("rp.c_fired").alias("code"), newest))


FAMILIES = {"kp": candle_alerts, "td": count_alerts, "nw": kernel_alerts, "vb": band_alerts, "htf": coarse_alerts, "rp": reversal_alerts}


def raise_alerts(bars: DataFrame, chart_sec: int, families=tuple(FAMILIES), last_closed_only=True, oi=None) -> DataFrame:
    """Alerts (symbol, timeframe, alert_id, time, family, code) on closed bars; the last bar of a key is still forming.

    With ``last_closed_only`` only the newest closed bar raises alerts, as in a run after each bar; without it every
    closed bar does, as in a backfill. The id is the bar's time and the code, so the same alert has one id in all runs.
    Empty bars give no row.
    """
    one = lambda name: FAMILIES[name](bars, chart_sec=chart_sec, oi=oi).withColumn("family", F.lit(name))
    rows = reduce(DataFrame.unionByName, [one(x) for x in families])
    rows = rows.filter("newest") if last_closed_only else rows
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(*KEYS, F.concat_ws("|", stamp, "code").alias("alert_id"), "time", "family", "code")


def extend_ledger(ledger: DataFrame | None, alerts: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """(whole ledger, alerts new to it); each alert keeps the run that raised it first in ``raised_in``.

    Known ids are left out by an anti-join on key and id, so a hot key is spread over its alerts. Repeats within a run count once.
    """
    fresh = alerts.dropDuplicates(list(ID))
    if ledger is not None:
        fresh = fresh.join(ledger.select(*ID), list(ID), "left_anti")
    fresh = cut_lineage(fresh.withColumn("raised_in", F.lit(run).cast("long")))
    return (fresh if ledger is None else ledger.unionByName(fresh)), fresh
