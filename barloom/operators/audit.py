"""Evidence checks on trade lists: possible fills, independence, luck, sample size, verdict.

All artifacts are audited in one job. A trade list row needs artifact_id, trade_no, symbol,
timeframe, entry_time, exit_time, side, entry_price and exit_price.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import LONGEST_MONTH_SECONDS, timeframe_seconds
from barloom.plans.asof import asof_join
from barloom.plans.blocks import KEYS, number_rows
from barloom.operators.rules import lint_status
from barloom.plans.folds import ordered_fold
from barloom.session import cut_lineage

c = F.col
WIDE = 64 * 86400
# Fixed values of the checks.
REL_EPS = 1e-9
SLACK_BARS = 5
CLOSE_FILL_WARN = 0.6
SAME_BAR_LIMIT = 0.5
OVERLAP_WARN, OVERLAP_ERROR = 0.3, 0.9
PASS_PERCENTILE = 0.95
GAP_WARN, GAP_LIMIT = 0.001, 0.005
SUBSTANTIVE = ("fill-validation", "random-baseline", "sample-power")
Z95 = 1.959964


def trade_return() -> Column:
    ratio = c("exit_price") / c("entry_price")
    return F.when(c("side") == "long", ratio - 1).otherwise(1 - ratio)


def fetch_window(trades: DataFrame) -> DataFrame:
    """Per artifact: from five bars before the first entry to one bar after the last exit."""
    seconds = F.coalesce(timeframe_seconds(), F.lit(LONGEST_MONTH_SECONDS)) * 1000000
    return trades.groupBy("artifact_id", *KEYS).agg(F.min("entry_time").alias("first"), F.max("exit_time").alias("last")).select(
        "artifact_id", *KEYS,
        F.timestamp_micros(F.unix_micros("first") - SLACK_BARS * seconds).alias("start"),
        F.timestamp_micros(F.unix_micros("last") + seconds).alias("end"),
    )


def place_trades(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry and exit bar of each trade inside its artifact's window; null rows are outside the data."""
    seconds = F.coalesce(timeframe_seconds(), F.lit(LONGEST_MONTH_SECONDS)) * 1000000
    b = bars.select(*KEYS, c("time").alias("_bt"), "rn", "low", "high", "close")
    window = asof_join(fetch_window(trades), b, KEYS, "start", "_bt", {"first_rn": "rn"}, forward=True, bucket_seconds=WIDE).drop("matched_time")
    window = asof_join(window, b, KEYS, "end", "_bt", {"last_rn": "rn"}, bucket_seconds=WIDE).withColumnRenamed("matched_time", "last_time")
    df = trades.join(window.select("artifact_id", "first_rn", "last_rn", "last_time"), "artifact_id")
    for side in ("entry", "exit"):
        wanted = {f"{side}_{x}": x for x in ("rn", "low", "high", "close")}
        df = asof_join(df, b, KEYS, f"{side}_time", "_bt", wanted, bucket_seconds=WIDE).drop("matched_time")
        inside = (
            (c(f"{side}_rn") >= c("first_rn"))
            & (F.unix_micros(f"{side}_time") < F.unix_micros("last_time") + seconds)
        )
        df = df.withColumns({x: F.when(inside, c(x)) for x in wanted})
    return df.withColumns(
        {"entry_idx": c("entry_rn") - c("first_rn"), "exit_idx": c("exit_rn") - c("first_rn"), "window_bars": c("last_rn") - c("first_rn") + 1}
    )


def _within(price, low, high, tolerance) -> Column:
    slack = max(REL_EPS, tolerance / 100)
    return (price >= low * (1 - slack)) & (price <= high * (1 + slack))


def fill_issues(placed: DataFrame, tolerance=0.0) -> DataFrame:
    """Per trade: which side is outside the data or at a price its bar never printed."""
    ok_in = _within(c("entry_price"), c("entry_low"), c("entry_high"), tolerance)
    ok_out = _within(c("exit_price"), c("exit_low"), c("exit_high"), tolerance)
    no_entry, no_exit = c("entry_rn").isNull(), c("exit_rn").isNull()
    scale = F.greatest(F.abs(c("entry_price")), F.abs(c("entry_close")), F.lit(1.0))
    return placed.withColumns(
        {
            "outside": no_entry | no_exit,
            "entry_issue": F.when(no_entry, "entry-outside-data").when(~ok_in, "impossible-entry-fill"),
            "exit_issue": F.when(~no_entry, F.when(no_exit, "exit-outside-data").when(~ok_out, "impossible-exit-fill")),
            "same_bar": F.coalesce(c("entry_rn") == c("exit_rn"), F.lit(False)),
            "close_fill": F.coalesce(F.abs(c("entry_price") - c("entry_close")) <= REL_EPS * scale, F.lit(False)),
        }
    )


def fill_validation(placed: DataFrame, tolerance=0.0) -> DataFrame:
    impossible = lambda x: F.coalesce(c(x).startswith("impossible"), F.lit(False)).cast("int")
    return fill_issues(placed, tolerance).groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("checked"),
        F.sum(impossible("entry_issue") + impossible("exit_issue")).alias("impossible"),
        F.count_if("outside").alias("outside"),
        F.count_if("same_bar").alias("same_bar"),
        F.count_if("close_fill").alias("close_fills"),
    )


GROUP = ("artifact_id", "side")


def independent_trades(placed: DataFrame) -> DataFrame:
    """Trades kept by greedy non-overlap per artifact and side, in entry order."""
    mapped = placed.filter("entry_idx is not null and exit_idx is not null")
    numbered = number_rows(mapped, GROUP, ("entry_idx", "exit_idx", "trade_no"), F.floor(c("entry_idx") / 4096))

    def step(state, values):
        trade, start, end = values
        if start > state["until"]:
            return {"until": end}, [(trade,)]
        return state, []

    kept = ordered_fold(numbered, ("trade_no", "entry_idx", "exit_idx"), {"until": -1}, step, "trade_no long", GROUP)
    return mapped.join(kept, ["artifact_id", "side", "trade_no"], "left_semi")


def independence(placed: DataFrame, kept: DataFrame) -> DataFrame:
    both = c("entry_idx").isNotNull() & c("exit_idx").isNotNull()
    a = placed.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("reported"), F.count_if(both).alias("mapped"))
    b = kept.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("effective"))
    df = a.join(b, "artifact_id", "left").withColumn("effective", F.coalesce("effective", F.lit(0)))
    overlap = F.when(c("mapped") > 0, 1 - c("effective") / F.nullif(c("mapped"), F.lit(0))).otherwise(0.0)
    return df.withColumn("overlap_ratio", overlap)


# ---- random baseline -------------------------------------------------------------------------

MASK = 0xFFFFFFFF
STEP = 0x6D2B79F5


def _imul(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of unsigned 32-bit numbers, in halves to stay inside a long."""
    high = F.shiftright(a, 16)
    low = a.bitwiseAND(F.lit(0xFFFF))
    return (low * b + (high * b).bitwiseAND(F.lit(0xFFFF)) * 65536).bitwiseAND(F.lit(MASK))


def uniform_draw(k: Column, seed: int) -> Column:
    """The k-th draw (from zero) of the counter-based 32-bit generator, in [0, 1)."""
    counter = ((k + 1) % (1 << 32)) * F.lit(STEP)
    t = (counter + F.lit(seed & MASK)).bitwiseAND(F.lit(MASK))
    t = _imul(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _imul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def _pair_return(entry: Column, exit_: Column) -> Column:
    return F.when(c("side") == "long", exit_ / entry - 1).otherwise(1 - exit_ / entry)


def _close_at(df: DataFrame, bars: DataFrame, position: str, name: str) -> DataFrame:
    """Close of the bar at a position; the join key spreads every symbol over its bars."""
    closes = bars.select(*KEYS, c("rn").alias(position), c("close").alias(name))
    return df.join(closes, [*KEYS, position])


def _templates(kept: DataFrame) -> DataFrame:
    """Kept trades in windows of three bars or more, with their holding time and the last place they can start at."""
    hold = F.greatest(F.lit(1), c("exit_idx") - c("entry_idx"))
    return kept.filter(c("window_bars") >= 3).withColumns({"hold": hold, "most": c("window_bars") - 1 - hold})


def mean_gaps(kept: DataFrame, bars: DataFrame) -> DataFrame:
    """Reported mean return and the close-to-close mean of the same trades, of artifacts with a trade that fits its window."""
    t = _templates(kept).withColumn("exit_at", c("first_rn") + F.least(c("window_bars") - 1, c("entry_idx") + c("hold")))
    shadow = _close_at(t, bars, "exit_at", "shadow_close")
    means = shadow.groupBy("artifact_id").agg(
        F.avg(_pair_return(c("entry_close"), c("shadow_close"))).alias("shadow_mean"),
        F.avg(trade_return()).alias("self_mean"),
        F.count(F.lit(1)).alias("trades_used"),
        F.bool_or(c("most") >= 0).alias("fits"),
    )
    return means.filter("fits").drop("fits")


def random_baseline(kept: DataFrame, bars: DataFrame, simulations=1000, seed=42) -> DataFrame:
    """Where the close-to-close mean return ranks among seeded random-entry twins.

    Draw number = simulation x templates + template, so every twin is drawn independently and in
    parallel. Ties count against the strategy.
    """
    own = mean_gaps(kept, bars)
    # Templates that fit the window are numbered in entry order; others use no draw.
    fits = number_rows(_templates(kept).filter("most >= 0"), ("artifact_id",), ("entry_idx", "exit_idx", "trade_no"), F.floor(c("entry_idx") / 4096))
    fits = fits.withColumns({"slot": c("rn") - 1, "slots": c("n")})
    sims = fits.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    draw = uniform_draw(c("sim").cast("long") * c("slots") + c("slot"), seed)
    sims = sims.withColumn("from_rn", c("first_rn") + F.floor(draw * (c("most") + 1)))
    sims = sims.withColumn("to_rn", c("from_rn") + c("hold")).select("artifact_id", *KEYS, "sim", "side", "from_rn", "to_rn")
    sims = _close_at(_close_at(sims, bars, "from_rn", "a"), bars, "to_rn", "z")
    means = sims.groupBy("artifact_id", "sim").agg(F.avg(_pair_return(c("a"), c("z"))).alias("m"))
    # One number per simulation: the list is as long as the simulation count.
    ranked = means.join(own, "artifact_id").groupBy("artifact_id").agg(
        F.sort_array(F.collect_list("m")).alias("ms"),
        F.count_if(c("m") < c("shadow_mean")).alias("below"),
        F.count(F.lit(1)).alias("simulations"),
        *[F.max(x).alias(x) for x in ("shadow_mean", "self_mean", "trades_used")],
    )
    at = lambda q: F.get("ms", F.floor(q * (c("simulations") - 1) + 0.5).cast("int"))
    return ranked.select(
        "artifact_id", "trades_used", "simulations", (c("below") / c("simulations")).alias("percentile"),
        "shadow_mean", "self_mean", at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"),
    )


# ---- sample size -----------------------------------------------------------------------------


def required_trades(edge: float, baseline=0.5, alpha=0.05, power=0.8) -> int:
    """Trades needed to see a win-rate edge over a fixed baseline (normal approximation)."""
    if not 0 < edge or baseline + edge >= 1:
        raise ValueError("the edge must be positive and leave the win rate below one")
    inv = NormalDist().inv_cdf
    p1 = baseline + edge
    spread = inv(1 - alpha / 2) * math.sqrt(baseline * (1 - baseline)) + inv(power) * math.sqrt(p1 * (1 - p1))
    return math.ceil((spread / edge) ** 2)


def wilson(wins: Column, n: Column, z: float = Z95):
    p, z2 = wins / n, z * z
    denominator = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denominator
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denominator
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def sample_power(kept: DataFrame, edge=0.05, baseline=0.5) -> DataFrame:
    """Win rate with its 95 % interval, and the trades needed on both dimensions."""
    inv = NormalDist().inv_cdf
    g = kept.withColumn("r", trade_return()).groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(c("r") > 0).alias("wins"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")
    )
    low, high = wilson(c("wins"), c("trades"))
    reach = (inv(0.975) + inv(0.8)) * c("sd") / F.abs(F.nullif(c("mean"), F.lit(0.0)))
    need = required_trades(edge, baseline)
    df = g.withColumns(
        {
            "win_rate": c("wins") / c("trades"), "ci_low": low, "ci_high": high, "required": F.lit(need),
            "required_mean": F.ceil(reach * reach),
        }
    )
    powered = (c("trades") >= need) & F.coalesce(c("trades") >= c("required_mean"), F.lit(False))
    return df.withColumn("powered", powered)


# ---- statuses and verdict --------------------------------------------------------------------


def check_statuses(headers: DataFrame, fills=None, independent=None, baseline=None, power=None, lint: DataFrame | None = None, gaps=None) -> DataFrame:
    """One row per artifact and check whose part is given. ``headers`` has artifact_id and costs_included.

    The fill model needs ``gaps`` (``mean_gaps``) only; a baseline holds the same means.

    ``lint`` holds findings of ``rules.lint_lines`` by artifact_id; an artifact without a finding passes.
    """
    df = headers
    for part in (fills, independent, baseline, gaps if baseline is None else None, power):
        df = df if part is None else df.join(part, "artifact_id", "left")
    has = lambda part, build: None if part is None else build()
    share = lambda x: c(x) / c("checked")
    gap = lambda: c("self_mean") - c("shadow_mean")
    checks = {
        "fill-validation": has(fills, lambda: F.when((c("impossible") > 0) | (c("outside") > 0), "error")
            .when(share("same_bar") > SAME_BAR_LIMIT, "not_proven")
            .when((share("close_fills") >= CLOSE_FILL_WARN) | (c("same_bar") > 0), "warn").otherwise("pass")),
        "independence": has(independent, lambda: F.when((c("mapped") > 0) & (c("overlap_ratio") > OVERLAP_ERROR), "error")
            .when(c("overlap_ratio") > OVERLAP_WARN, "warn").otherwise("pass")),
        "random-baseline": has(baseline, lambda: F.when(c("percentile").isNull(), "skipped")
            .when(c("percentile") >= PASS_PERCENTILE, "pass").otherwise("not_proven")),
        "fill-model": has(gaps if baseline is None else baseline, lambda: F.when(gap().isNull(), "skipped").when(gap() > GAP_LIMIT, "not_proven")
            .when(gap() > GAP_WARN, "warn").otherwise("pass")),
        "sample-power": has(power, lambda: F.when(F.coalesce(c("powered"), F.lit(False)), "pass").otherwise("not_proven")),
        "plausibility": has(power, lambda: F.when((c("trades") > 50) & (c("ci_low") > 0.9), "warn").otherwise("pass")),
        "costs": F.when(F.coalesce(c("costs_included"), F.lit(False)), "pass").otherwise("warn"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items() if v is not None])
    out = df.select("artifact_id", F.explode(rows).alias("x")).select("artifact_id", "x.check", "x.status")
    if lint is not None:
        found = headers.select("artifact_id").join(lint_status(lint, "artifact_id"), "artifact_id", "left")
        out = out.unionByName(found.select("artifact_id", F.lit("lookahead-lint").alias("check"), F.coalesce("status", F.lit("pass")).alias("status")))
    return out


def verdicts(checks: DataFrame) -> DataFrame:
    """Errors beat doubts; a substantive check that did not run is a doubt."""
    ran = F.collect_set(F.when((c("status") != "skipped") & c("check").isin(*SUBSTANTIVE), c("check")))
    g = checks.groupBy("artifact_id").agg(
        F.bool_or(c("status") == "error").alias("bad"),
        F.bool_or(c("status") == "not_proven").alias("doubt"),
        F.count_if(c("status") == "warn").alias("warnings"),
        F.size(ran).alias("ran"),
    )
    verdict = (
        F.when(c("bad"), "DEFECTS_FOUND")
        .when(c("doubt") | (c("ran") < len(SUBSTANTIVE)), "NOT_PROVEN")
        .otherwise("NO_DEFECTS_FOUND")
    )
    return g.select("artifact_id", verdict.alias("verdict"), "warnings")


def audit(trades: DataFrame, headers: DataFrame, bars: DataFrame, simulations=1000, seed=42, edge=0.05, lint=None) -> DataFrame:
    """Status rows of all checks, that of the source code too where its findings are given.

    Placed and kept trades are written once and reused by every check.
    """
    placed = cut_lineage(place_trades(trades, bars))
    kept = cut_lineage(independent_trades(placed))
    return check_statuses(
        headers, fill_validation(placed), independence(placed, kept), random_baseline(kept, bars, simulations, seed), sample_power(kept, edge), lint
    )


# ---- artifact JSON ---------------------------------------------------------------------------

ARTIFACT_SCHEMA = (
    "version double, symbol string, timeframe string, trades array<struct<entryTime:string,exitTime:string,side:string,"
    "entryPrice:double,exitPrice:double>>, costs struct<included:boolean>"
)


def parse_artifacts(raw: DataFrame, column="json") -> DataFrame:
    """Parsed artifacts with the first failing field named, or null when the artifact is valid."""
    from barloom.functions.exprs import TIMEFRAME_SECONDS

    a = raw.withColumn("a", F.from_json(c(column), ARTIFACT_SCHEMA))
    instant = lambda x: F.try_to_timestamp(x)
    price_ok = lambda x: F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))

    def first_fault(t, i):
        at = lambda field: F.concat(F.lit("trades["), i.cast("string"), F.lit(f"].{field}"))
        return (
            F.when(instant(t["entryTime"]).isNull(), at("entryTime"))
            .when(instant(t["exitTime"]).isNull(), at("exitTime"))
            .when(instant(t["exitTime"]) < instant(t["entryTime"]), at("order"))
            .when(~F.coalesce(t["side"].isin("long", "short"), F.lit(False)), at("side"))
            .when(~price_ok(t["entryPrice"]), at("entryPrice"))
            .when(~price_ok(t["exitPrice"]), at("exitPrice"))
        )

    faults = F.array_compact(F.transform("a.trades", first_fault))
    bad = (
        F.when(c("a").isNull() | F.coalesce(~F.trim(c(column)).startswith("{"), F.lit(True)), "json")
        .when(~F.coalesce(c("a.version") == 1, F.lit(False)), "version")
        .when(F.coalesce(F.length("a.symbol"), F.lit(0)) == 0, "symbol")
        .when(~F.coalesce(c("a.timeframe").isin(*TIMEFRAME_SECONDS), F.lit(False)), "timeframe")
        .when(F.coalesce(F.size("a.trades"), F.lit(-1)) <= 0, "trades")
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
    )
    return a.withColumn("bad_field", bad)


def artifact_trades(parsed: DataFrame, id_column="artifact_id") -> DataFrame:
    """Trade rows of the valid artifacts."""
    good = parsed.filter("bad_field is null").select(id_column, "a.symbol", "a.timeframe", F.posexplode("a.trades").alias("trade_no", "t"))
    return good.select(
        id_column, c("trade_no").cast("long").alias("trade_no"), "symbol", "timeframe",
        F.to_timestamp("t.entryTime").alias("entry_time"), F.to_timestamp("t.exitTime").alias("exit_time"),
        "t.side", c("t.entryPrice").alias("entry_price"), c("t.exitPrice").alias("exit_price"),
    )
