"""A-share order rules, tool and authority rules, stores and text lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import col as c
from barloom.functions.exprs import half_up, printed
from barloom.sources.text import board

# ---- A-share orders --------------------------------------------------------------------------

# Statutory limits and fee rates.
LIMITS = {"star": 0.2, "chi_next": 0.2, "bse": 0.3, "main": 0.1}
ST_LIMIT = 0.05
COMMISSION, MIN_COMMISSION, STAMP, TRANSFER = 0.00025, 5.0, 0.0005, 0.00001


def limit_ratio(symbol="symbol", is_st="is_st") -> Column:
    b = board(symbol)
    by_board = F.when(b.isin("star", "chi_next"), 0.2).when(b == "bse", LIMITS["bse"]).otherwise(LIMITS["main"])
    return F.when(F.coalesce(c(is_st), F.lit(False)), ST_LIMIT).otherwise(by_board)


def price_limits(orders: DataFrame) -> DataFrame:
    """Limit prices to the cent and whether the order price is inside them."""
    df = orders.withColumns({"board": board("symbol"), "limit_ratio": limit_ratio()})
    cent = lambda x: half_up(x + 1e-8, 2)
    df = df.withColumns({"limit_up": cent(c("prev_close") * (1 + c("limit_ratio"))), "limit_down": cent(c("prev_close") * (1 - c("limit_ratio")))})
    reason = (
        F.when(~(c("prev_close") > 0), "bad_previous_close").when(c("price") > c("limit_up"), "above_limit").when(c("price") < c("limit_down"), "below_limit")
    )
    return df.withColumns({"reason": reason, "valid": reason.isNull()})


def t_plus_one(orders: DataFrame) -> DataFrame:
    """Shares bought today cannot be sold today."""
    locked = F.greatest(F.lit(0), c("today_bought"))
    available = F.greatest(F.lit(0), c("total_shares") - locked)
    reason = F.when(c("shares") <= 0, "not_positive").when(c("shares") > available, "locked")
    return orders.withColumns({"locked_shares": locked, "available_shares": available, "reason": reason, "valid": reason.isNull()})


def lot_size(orders: DataFrame) -> DataFrame:
    """Round lots for buys (the growth board: at least 200), odd lots only when selling everything."""
    n, buys = c("shares"), c("side") == "buy"
    whole = (n > 0) & (n == F.floor(n))
    odd = n % 100 != 0
    star = board("symbol") == "star"
    reason = (
        F.when(~whole, "not_positive_integer")
        .when(buys & star & (n < 200), "star_minimum")
        .when(buys & ~star & odd, "round_lot")
        .when(~buys & odd & c("total_shares").isNotNull() & (n != c("total_shares")), "odd_lot")
    )
    return orders.withColumns({"reason": reason, "valid": reason.isNull()})


def trade_costs(orders: DataFrame) -> DataFrame:
    """Stamp duty, transfer fee, commission with its minimum, settlement and effective rate."""
    sells = c("side") == "sell"
    df = orders.withColumn("gross", half_up(c("shares") * c("price"), 2))
    df = df.withColumns(
        {
            "stamp_duty": F.when(sells, half_up(c("gross") * STAMP, 2)).otherwise(0.0),
            "transfer_fee": half_up(c("gross") * TRANSFER, 2),
            "commission": F.greatest(F.lit(MIN_COMMISSION), half_up(c("gross") * COMMISSION, 2)),
        }
    )
    df = df.withColumn("total_fees", half_up(c("stamp_duty") + c("transfer_fee") + c("commission"), 2))
    return df.withColumns(
        {
            "settlement": half_up(F.when(sells, c("gross") - c("total_fees")).otherwise(c("gross") + c("total_fees")), 2),
            "effective_rate_pct": F.when(c("gross") > 0, half_up(c("total_fees") / F.nullif(c("gross"), F.lit(0.0)) * 100, 2)).otherwise(0.0),
        }
    )


# ---- tool policy and authority ---------------------------------------------------------------

# Default refusal patterns, in order.
DENY = (
    "^(place|submit|send|create|open|cancel|amend|modify|replace|execute)_(order|orders|trade|trades)$",
    "^(order|orders|trade|trades)_(place|submit|send|create|cancel|amend|modify|replace|execute)$",
    "^(buy|sell|short|cover|long)(_.*)?$",
    "^(open|close|flatten|liquidate|exit)_(position|positions)$",
    "^(withdraw|withdrawal|deposit|transfer|remit|swap|bridge)(_.*)?$",
)


def tool_policy(log: DataFrame, name="tool", deny=DENY, allow=(), mode="denylist") -> DataFrame:
    """Verdict per logged tool name and the number of the first pattern that refuses it."""
    exempt = c(name).isin(*allow) if allow else F.lit(False)
    if mode == "allowlist":
        return log.withColumns({"allowed": exempt, "rule": F.lit(None).cast("long")})
    hit = F.coalesce(*[F.when(c(name).rlike(f"(?i){p}"), F.lit(i + 1)) for i, p in enumerate(deny)]).cast("long")
    rule = F.when(~exempt, hit)
    return log.withColumns({"allowed": rule.isNull(), "rule": rule})


def grant_rules(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Verdict per request: paper passes; live needs a live, unexpired grant covering symbol and size.

    A request is held against one grant: that of its account which is valid longest, then the last by id.
    Signatures are not checked here.
    """
    newest = F.max_by(F.struct(*[x for x in grants.columns if x != "account"]), F.struct("valid_until", "grant_id"))
    one = grants.groupBy("account").agg(newest.alias("g")).select("account", "g.*")
    df = requests.join(one, "account", "left")
    listed = F.exists("allowed_symbols", lambda s: (s == "*") | (F.upper(s) == F.upper(c("symbol"))))
    reason = (
        F.when(F.coalesce(c("mode"), F.lit("paper")) == "paper", "paper")
        .when(c("grant_id").isNull(), "no_grant")
        .when(c("grant_mode") != "live", "not_live")
        .when(c("valid_until").isNull() | (c("requested_at") > c("valid_until")), "expired")
        .when(~F.coalesce(listed, F.lit(False)), "symbol")
        .when(c("notional") > c("max_position"), "size")
        .otherwise("live")
    )
    return df.withColumns({"reason": reason, "allowed": reason.isin("paper", "live")})


# ---- source lint -----------------------------------------------------------------------------

# Fixed values: (id, severity, pattern, pattern that excuses the line).
LINT_RULES = (
    ("LK001", "error", r"\bshift\s*\(\s*-\s*\d", None),
    ("LK002", "error", r"rolling\s*\([^)]*center\s*=\s*True", None),
    ("LK003", "error", r"np\.roll\s*\([^)]*,\s*-\s*\d", None),
    ("LK004", "warn", r"\bbfill\s*\(|fillna\s*\([^)]*(method\s*=\s*['\"]bfill['\"]|['\"]backfill['\"])", None),
    ("LK005", "warn", r"\.fit\s*\(\s*(df|X|data|features)\b", "(?i)train"),
    ("LK006", "warn", r"\blead\s*\(", None),
)
LINT_ADVICE = {
    "LK001": ("a negative shift reads later bars", "shift forward, or compare with earlier bars"),
    "LK002": ("a centred window holds later bars", "use a trailing window"),
    "LK003": ("rolling an array backwards brings later values to earlier bars", "roll forward and drop what wraps round"),
    "LK004": ("filling backwards copies later values to earlier bars", "fill forward"),
    "LK005": ("fitting on all rows lets the test period shape the model", "fit on the training rows only"),
    "LK006": ("lead reads later rows", "use lag"),
}
COMMENT = r"^(#|//|\*|/\*|--|'''|\"\"\")"


def source_lines(texts: DataFrame, name="file", text="text") -> DataFrame:
    """One row per line of a text, numbered from one."""
    return texts.select(name, F.posexplode(F.split(c(text), "\r?\n")).alias("pos", "line")).select(name, (c("pos") + 1).alias("line_no"), "line")


def lint_lines(lines: DataFrame) -> DataFrame:
    """Findings of all rules with the whole line, the reason and a remedy; a comment line only warns."""
    advice = F.create_map(*[x for rule, (why, fix) in LINT_ADVICE.items() for x in (F.lit(rule), F.struct(F.lit(why).alias("why"), F.lit(fix).alias("fix")))])
    comment = F.trim("line").rlike(COMMENT)
    found = []
    for rule, severity, pattern, excuse in LINT_RULES:
        hit = c("line").rlike(pattern)
        if excuse:
            hit = hit & ~c("line").rlike(excuse)
        level = F.when(comment, "warn").otherwise(severity)
        found.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), level.alias("severity"))))
    return lines.withColumn("f", F.explode(F.array_compact(F.array(*found)))).select(
        *[x for x in lines.columns if x != "line"], "f.rule", "f.severity", F.trim("line").alias("excerpt"), *[F.get(F.map_values(F.map_filter(advice, lambda k, _: k == c("f.rule"))), F.lit(0))[x].alias(x) for x in ("why", "fix")]
    )


def lint_status(findings: DataFrame, name="file") -> DataFrame:
    bad = c("severity") == "error"
    return findings.groupBy(name).agg(
        F.count_if(bad).alias("errors"), F.count_if(~bad).alias("warnings"), F.when(F.bool_or(bad), "error").otherwise("warn").alias("status")
    )


# ---- stores ----------------------------------------------------------------------------------

DEFAULT_GROUP = "自选"


def watch_upsert(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items keyed by (upper-cased symbol, group); the newest notes win, the first time is kept."""
    both = items.unionByName(changes)
    key = {"symbol": F.upper("symbol"), "grp": F.coalesce(F.nullif(F.trim("grp"), F.lit("")), F.lit(DEFAULT_GROUP))}
    return both.withColumns(key).groupBy("symbol", "grp").agg(
        F.nullif(F.max_by("notes", F.struct("added_at", "seq")), F.lit("")).alias("notes"), F.min("added_at").alias("added_at")
    )


def watch_remove(items: DataFrame, removals: DataFrame) -> DataFrame:
    """Drop by (symbol, group), or by symbol in every group when no group is given."""
    r = removals.select(F.upper("symbol").alias("_s"), c("grp").alias("_g"))
    same = F.upper(items["symbol"]) == c("_s")
    everywhere = r.filter("_g is null")
    listed = r.filter("_g is not null")
    out = items.join(everywhere, same, "left_anti")
    return out.join(listed, (F.upper(out["symbol"]) == c("_s")) & (out["grp"] == c("_g")), "left_anti")


def thesis_status(log: DataFrame) -> DataFrame:
    """Newest status per thesis."""
    return log.groupBy("thesis_id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"))


def thesis_query(theses: DataFrame, symbol=None, status=None, direction=None, tag=None) -> DataFrame:
    out = theses
    if symbol:
        out = out.filter(c("symbol") == symbol.upper())
    if status:
        out = out.filter(c("status") == status)
    if direction:
        out = out.filter(c("direction") == direction)
    if tag:
        out = out.filter(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    return out


def tag_counts(theses: DataFrame) -> DataFrame:
    return theses.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(c("count").desc(), "tag")


def recent_runs(log: DataFrame, keep=100, per_task: int | None = None) -> DataFrame:
    """The newest ``keep`` runs overall, and of these the newest ``per_task`` of each task.

    The overall cut is a top-k, which Spark merges from per-partition heaps.
    """
    out = log.orderBy(c("run_at").desc(), c("run_id").desc()).limit(keep)
    if per_task is not None:
        w = Window.partitionBy("task_id").orderBy(c("run_at").desc(), c("run_id").desc())
        out = out.withColumn("_k", F.row_number().over(w)).filter(c("_k") <= per_task).drop("_k")
    return out


def funding_anomalies(rates: DataFrame, threshold_pct=0.03) -> DataFrame:
    return rates.withColumns({"rate_pct": printed(c("funding_rate") * 100, 4), "anomaly": F.abs(c("funding_rate") * 100) >= threshold_pct})


def watch_summary(bars: DataFrame) -> DataFrame:
    """Latest close and its change per symbol, from the last two bars."""
    from barloom.operators.holdings import last_two_closes

    df = last_two_closes(bars).filter("previous_close is not null")
    return df.withColumn("change_pct", F.round((c("price") - c("previous_close")) / c("previous_close") * 100, 2))


# ---- text forms of numbers -------------------------------------------------------------------


def compact_amount(x, signed=False) -> Column:
    """亿 above 1e8, 万 above 1e4, else a whole number."""
    v = c(x)
    sign = F.when(v < 0, "-").when((v > 0) & F.lit(signed), "+").otherwise("")
    a = F.abs(v)
    text = F.when(a >= 1e8, F.concat(printed(a / 1e8, 2), F.lit("亿"))).when(a >= 1e4, F.concat(printed(a / 1e4, 1), F.lit("万"))).otherwise(printed(a, 0))
    return F.when(v.isNull() | F.isnan(v), "–").otherwise(F.concat(sign, text))


def signed_pct(x, digits=2) -> Column:
    v = c(x)
    return F.when(v.isNull() | F.isnan(v), "–").otherwise(F.concat(F.when(v >= 0, "+").otherwise("-"), printed(F.abs(v), digits), F.lit("%")))
