"""Holdings, order rules and stores as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, over, q, query, r, tidy
from barloom.operators import holdings as H
from barloom.operators import rules as R
from barloom.sources.bars import line_ticks, table

c = F.col
TL = """tl AS MATERIALIZED (SELECT symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, quantity, price, l_tax * price AS fee, ts AS committed_at,
  lpad(seq[1]::VARCHAR, 12, '0') || '/' || seq[2] || '/' || seq[3] || '/' || seq[4] || '/' || quantity::INT || '/' || round(seq[6] * 100)::BIGINT AS id FROM ticks)"""


def trade_log(spark, d):
    t = line_ticks(spark, d)
    key = F.concat_ws("/", F.lpad(c("seq.l_orderkey").cast("string"), 12, "0"), c("seq.l_linenumber").cast("string"), c("seq.l_partkey").cast("string"), c("seq.l_suppkey").cast("string"),
                      c("quantity").cast("int").cast("string"), F.round(c("seq.l_extendedprice") * 100).cast("long").cast("string"))
    return t.select("symbol", F.when(c("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), "quantity", "price",
                    (c("l_tax") * c("price")).alias("fee"), c("ts").alias("committed_at"), key.alias("id"))


# The recursion mirrors weighted-average cost with rounding after each trade.
LG = f"""{TL},
lo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY committed_at, id) AS rn, count(*) OVER (PARTITION BY symbol) AS n, CASE side WHEN 'buy' THEN quantity ELSE -quantity END AS sg FROM tl),
lg AS (SELECT symbol, 0::BIGINT AS rn, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS av, 0.0::DOUBLE AS pnl FROM lo WHERE rn = 1
  UNION ALL SELECT o.symbol, o.rn, round(af, 8), round(CASE WHEN addq THEN CASE WHEN af = 0 THEN 0 ELSE (abs(g.qty) * g.av + o.quantity * o.price + CASE o.side WHEN 'buy' THEN o.fee ELSE -o.fee END) / abs(af) END
      WHEN af = 0 THEN 0 WHEN af * g.qty < 0 THEN o.price ELSE g.av END, 4),
    round(g.pnl + CASE WHEN addq THEN 0 ELSE CASE WHEN g.qty > 0 THEN o.price - g.av ELSE g.av - o.price END * least(abs(g.qty), o.quantity) - o.fee END, 4)
  FROM lg g JOIN lo o ON o.symbol = g.symbol AND o.rn = g.rn + 1, LATERAL (SELECT g.qty + o.sg AS af, g.qty * o.sg >= 0 AS addq))"""
POS = f"{LG}, ps AS (SELECT lg.*, round(abs(qty) * av, 4) AS basis FROM lg JOIN lo USING (symbol, rn) WHERE rn = n)"


def positions_of(spark, d):
    return H.positions_held(trade_log(spark, d), None)


@query("ledger_positions", over(f", {POS} SELECT symbol, 'USD' AS currency, {q('qty')} AS quantity, {q('av', 4)} AS average_cost, {q('pnl', 1)} AS realized_pnl FROM ps", "brand", True))
def _(spark, d):
    p = positions_of(spark, d)
    return p.select("symbol", "currency", r("quantity").alias("quantity"), r("average_cost", 4).alias("average_cost"), r("realized_pnl", 1).alias("realized_pnl"))


MK = f"""{POS}, mk AS (SELECT symbol, max(close) FILTER (rn = n) AS px, max(close) FILTER (rn = n - 1) AS pv FROM b GROUP BY symbol),
mv AS (SELECT ps.*, px, pv, CASE WHEN symbol LIKE '%1' THEN 'CNY' WHEN symbol LIKE '%2' THEN 'USDT' ELSE 'USD' END AS ccy, round(qty * px, 4) AS value, CASE WHEN qty <> 0 AND av > 0 THEN round((px - av) * qty, 4) ELSE 0 END AS upnl,
  CASE WHEN pv > 0 AND qty <> 0 THEN round((px - pv) * qty, 4) END AS today FROM ps JOIN mk USING (symbol))"""


def with_currency(rows):
    return rows.withColumn("currency", F.when(c("symbol").endswith("1"), "CNY").when(c("symbol").endswith("2"), "USDT").otherwise("USD"))


def marked_of(spark, d):
    """Positions marked to the daily bars, with currencies spread over the symbols."""
    return H.mark(with_currency(positions_of(spark, d)), H.last_two_closes(bars(spark, d)))


@query("join_marks_prices", over(f", {MK} SELECT symbol, {q('px')} AS price, {q('pv')} AS previous_close FROM mk", "brand", True))
def _(spark, d):
    return tidy(H.last_two_closes(bars(spark, d)), "symbol", "price", "previous_close")


@query("ledger_mark", over(f", {MK} SELECT symbol, {q('value', 2)} AS market_value, {q('upnl', 2)} AS unrealized_pnl, {q('today', 2)} AS today_pnl, {q('(px - pv) / pv * 100', 2)} AS today_pct FROM mv", "brand", True))
def _(spark, d):
    m = marked_of(spark, d)
    return m.select("symbol", r("market_value", 2).alias("market_value"), r("unrealized_pnl", 2).alias("unrealized_pnl"), r("today_pnl", 2).alias("today_pnl"),
                    r((c("price") - c("previous_close")) / c("previous_close") * 100, 2).alias("today_pct"))


@query("ledger_t1_roll", over(f""", {TL}, x AS (SELECT symbol, arg_max(quantity, (committed_at, id)) AS q, arg_max(CASE WHEN strftime(committed_at + INTERVAL 8 HOUR, '%Y-%m-%d') = '1998-12-01' THEN quantity ELSE 0 END, (committed_at, id)) AS lk FROM tl GROUP BY symbol)
SELECT symbol, {q('lk')} AS locked, {q('greatest(0, q - lk)')} AS sellable FROM x"""))
def _(spark, d):
    last = trade_log(spark, d).groupBy("symbol").agg(F.max_by(F.struct("quantity", "committed_at"), F.struct("committed_at", "id")).alias("t"))
    p = last.select("symbol", c("t.quantity").alias("quantity"), c("t.quantity").alias("locked"), H.shanghai_day("t.committed_at").alias("trade_day"))
    return tidy(H.roll_lock(p, F.lit("1998-12-01 02:00:00").cast("timestamp")), "symbol", "locked", "sellable")


QT = """qt(ccy, per_usd) AS (SELECT CASE n_nationkey WHEN 0 THEN 'USDT' WHEN 1 THEN 'CNY' ELSE 'X' || n_nationkey END, CASE n_nationkey WHEN 0 THEN 1.0004 WHEN 1 THEN 7.1234 ELSE 1 + n_nationkey END FROM nation),
fx AS (SELECT ccy, round(CASE ccy WHEN 'USD' THEN 1 ELSE 1 / (SELECT per_usd FROM qt WHERE qt.ccy = k.ccy) END * 1.0004, 8) AS rate FROM (VALUES ('USDT'), ('USD'), ('CNY')) k(ccy))"""


def quotes(spark, d):
    k = c("n_nationkey")
    name = F.when(k == 0, "USDT").when(k == 1, "CNY").otherwise(F.concat(F.lit("X"), k.cast("string")))
    return table(spark, d, "nation").select(name.alias("ccy"), F.when(k == 0, 1.0004).when(k == 1, 7.1234).otherwise(1.0 + k).alias("per_usd"))


@query("fx_rates", f"WITH {QT} SELECT 'USDT' AS base, ccy, {q('rate', 6)} AS rate FROM fx")
def _(spark, d):
    return tidy(H.fx_rates(quotes(spark, d)), "base", "ccy", "rate", digits=6)


@query("join_fx", over(f", {MK}, {QT} SELECT symbol, ccy AS currency, {q('coalesce(rate, 1)', 6)} AS rate FROM mv LEFT JOIN fx USING (ccy)", "brand", True))
def _(spark, d):
    # Rates hang on currencies alone: every symbol of the log has a position, and none of its figures is read.
    held = with_currency(trade_log(spark, d).select("symbol").distinct())
    return tidy(H.with_rate(held, H.fx_rates(quotes(spark, d))), "symbol", "currency", "rate", digits=6)


@query("agg_portfolio_ccy", over(f""", {MK} SELECT ccy AS currency, {q('sum(value)', 1)} AS market_value, {q('sum(basis)', 1)} AS cost, {q('sum(upnl)', 1)} AS unrealized, {q('sum(pnl)', 1)} AS realized, {q('sum(coalesce(today, 0))', 1)} AS today,
{q('sum(CASE WHEN value >= 0 THEN value ELSE 0 END)', 1)} AS long_exposure, {q('sum(CASE WHEN value < 0 THEN -value ELSE 0 END)', 1)} AS short_exposure FROM mv GROUP BY ccy""", "brand", True))
def _(spark, d):
    g = H.by_currency(marked_of(spark, d))
    return tidy(g, "currency", "market_value", "cost", "unrealized", "realized", "today", "long_exposure", "short_exposure", digits=1)


@query("agg_portfolio_nav", over(f""", {MK}, {QT}, z AS (SELECT *, coalesce(rate, 1) AS k FROM mv LEFT JOIN fx USING (ccy))
SELECT {q('sum(value * k)', 2)} AS nav, {q('sum(basis * k)', 2)} AS cost, {q('sum(upnl * k)', 2)} AS unrealized, {q('sum(coalesce(today, 0) * k)', 2)} AS today, {q('sum(abs(value) * k)', 2)} AS gross FROM z""", "brand", True))
def _(spark, d):
    n = H.nav(marked_of(spark, d), H.fx_rates(quotes(spark, d)))
    return tidy(n.withColumn("gross", c("long_exposure") + c("short_exposure")), "nav", "cost", "unrealized", "today", "gross", digits=2)


@query("agg_weights_topname", over(f""", {MK}, {QT}, z AS (SELECT symbol, abs(value) * coalesce(rate, 1) AS v FROM mv LEFT JOIN fx USING (ccy)), w AS (SELECT symbol, v / sum(v) OVER () * 100 AS w FROM z)
SELECT {q('max(w)', 2)} AS max_weight_pct, arg_max(symbol, w) AS max_weight_symbol FROM w""", "brand", True))
def _(spark, d):
    w = H.weights(marked_of(spark, d), H.fx_rates(quotes(spark, d)))
    return tidy(H.top_name(w), digits=2)


@query("pred_holdings_filter", over(f", {POS} SELECT symbol, {q('qty')} AS quantity FROM ps WHERE symbol IN ('Brand#11', 'Brand#23')", "brand", True))
def _(spark, d):
    return tidy(H.positions_held(trade_log(spark, d), ["brand#11", "BRAND#23", "none"]), "symbol", "quantity")


ACT = """ac AS (SELECT o_orderkey::VARCHAR AS id, 'staged' AS status, o_orderdate AS t FROM orders UNION ALL SELECT o_orderkey::VARCHAR, CASE o_orderstatus WHEN 'F' THEN 'committed' ELSE 'discarded' END, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderkey % 3 <> 0)"""


@query("ledger_staging", f"WITH {ACT} SELECT id, arg_max(status, row(t, status)) AS status, min(t) AS staged_at, max(t) AS changed_at FROM ac GROUP BY id")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("t", c("o_orderdate").cast("timestamp"))
    first = o.select(c("o_orderkey").cast("string").alias("id"), F.lit("staged").alias("status"), c("t").alias("at"))
    second = o.filter(c("o_orderkey") % 3 != 0).select(c("o_orderkey").cast("string").alias("id"), F.when(c("o_orderstatus") == "F", "committed").otherwise("discarded").alias("status"),
                                                       F.timestamp_micros(F.unix_micros("t") + 86400000000).alias("at"))
    return tidy(H.list_staged(first.unionByName(second), None))


# ---- A-share rules ---------------------------------------------------------------------------

ORD = """od AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '688' WHEN 1 THEN '300' WHEN 2 THEN '830' WHEN 3 THEN 'sh600' ELSE '000' END || lpad((o_custkey % 1000)::VARCHAR, 3, '0') AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 300 ELSE (o_custkey % 40) * 100 END AS shares, o_totalprice / 1000 AS prev_close, o_totalprice / 1000 * (0.75 + (o_orderkey % 60) / 100.0) AS price, o_orderkey % 7 = 0 AS is_st, o_custkey % 500 AS total_shares, o_custkey % 90 AS today_bought FROM orders),
ob AS (SELECT *, regexp_replace(symbol, '^[a-z]+', '') AS code FROM od),
oz AS (SELECT *, CASE WHEN code LIKE '688%' THEN 'star' WHEN code LIKE '30%' THEN 'chi_next' WHEN regexp_matches(code, '^(8|4|92)') THEN 'bse' ELSE 'main' END AS board FROM ob)"""


def orders_of(spark, d):
    k = c("o_orderkey") % 5
    head = F.when(k == 0, "688").when(k == 1, "300").when(k == 2, "830").when(k == 3, "sh600").otherwise("000")
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), F.concat(head, F.lpad((c("o_custkey") % 1000).cast("string"), 3, "0")).alias("symbol"), F.when(c("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.when(c("o_orderkey") % 4 == 0, c("o_custkey") % 300).otherwise((c("o_custkey") % 40) * 100).alias("shares"), (c("o_totalprice") / 1000).alias("prev_close"),
        (c("o_totalprice") / 1000 * (0.75 + (c("o_orderkey") % 60) / 100.0)).alias("price"), (c("o_orderkey") % 7 == 0).alias("is_st"), (c("o_custkey") % 500).alias("total_shares"), (c("o_custkey") % 90).alias("today_bought"),
    )


cent = lambda x: f"(floor(({x}) * 100 + 0.5) / 100)"


@query("cn_price_limits", f"""WITH {ORD}, z AS (SELECT *, CASE WHEN is_st THEN 0.05 WHEN board IN ('star', 'chi_next') THEN 0.2 WHEN board = 'bse' THEN 0.3 ELSE 0.1 END::DOUBLE AS k FROM oz),
y AS (SELECT *, {cent('prev_close * (1 + k) + 1e-8')} AS up, {cent('prev_close * (1 - k) + 1e-8')} AS dn FROM z) SELECT id, board, k AS limit_ratio, up AS limit_up, dn AS limit_down, CASE WHEN price > up THEN 'above_limit' WHEN price < dn THEN 'below_limit' END AS reason FROM y""")
def _(spark, d):
    return R.price_limits(orders_of(spark, d)).select("id", "board", "limit_ratio", "limit_up", "limit_down", "reason")


@query("cn_t1_check", f"WITH {ORD} SELECT id, greatest(0, total_shares - today_bought) AS available_shares, CASE WHEN shares <= 0 THEN 'not_positive' WHEN shares > greatest(0, total_shares - today_bought) THEN 'locked' END AS reason FROM od")
def _(spark, d):
    return R.t_plus_one(orders_of(spark, d)).select("id", "available_shares", "reason")


@query("cn_lot_check", f"""WITH {ORD} SELECT id, CASE WHEN shares <= 0 THEN 'not_positive_integer' WHEN side = 'buy' AND board = 'star' AND shares < 200 THEN 'star_minimum' WHEN side = 'buy' AND board <> 'star' AND shares % 100 <> 0 THEN 'round_lot'
 WHEN side = 'sell' AND shares % 100 <> 0 AND shares <> total_shares THEN 'odd_lot' END AS reason FROM oz""")
def _(spark, d):
    return R.lot_size(orders_of(spark, d)).select("id", "reason")


@query("cn_costs", f"""WITH {ORD}, a AS (SELECT *, {cent('shares * price')} AS gross FROM od), z AS (SELECT *, CASE side WHEN 'sell' THEN {cent('gross * 0.0005')} ELSE 0 END AS stamp, {cent('gross * 0.00001')} AS tf, greatest(5, {cent('gross * 0.00025')}) AS cm FROM a),
y AS (SELECT *, {cent('stamp + tf + cm')} AS fees FROM z) SELECT id, gross, stamp AS stamp_duty, tf AS transfer_fee, cm AS commission, fees AS total_fees, {cent("CASE side WHEN 'buy' THEN gross + fees ELSE gross - fees END")} AS settlement, CASE WHEN gross > 0 THEN {cent('fees / gross * 100')} ELSE 0 END AS effective_rate_pct FROM y""")
def _(spark, d):
    return R.trade_costs(orders_of(spark, d)).select("id", "gross", "stamp_duty", "transfer_fee", "commission", "total_fees", "settlement", "effective_rate_pct")


# ---- rules over logs -------------------------------------------------------------------------

TOOLS = ("place_order", "orders_cancel", "buy_now", "get_quote", "close_position", "withdraw", "market_snapshot", "BUY", "sellers")
TOOL_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOOLS)) + " END"


@query("pred_tool_policy", f"""WITH t AS (SELECT event_id, {TOOL_SQL} AS tool FROM events), z AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(tool, '{p}', 'i') THEN {i + 1}" for i, p in enumerate(R.DENY))} END AS hit FROM t)
SELECT event_id, tool, tool = 'withdraw' OR hit IS NULL AS allowed, CASE WHEN tool <> 'withdraw' THEN hit END::BIGINT AS rule FROM z""")
def _(spark, d):
    tool = F.get(F.array(*[F.lit(t) for t in TOOLS]), (c("event_id") % 9).cast("int"))
    return R.tool_policy(table(spark, d, "events").select("event_id", tool.alias("tool")), allow=("withdraw",))


LEAKS = ("x = df.close.shift(-1)", "# df.shift( - 2 )", "m = df.rolling(5, center=True).mean()", "np.roll(a, -3)", "df.bfill()", "df.fillna(method='bfill')", "sc.fit(df)", "sc.fit(df)  # train only", "lead(close, 1)", "y = df.shift(1)")
LIT = ", ".join("('" + x.replace("'", "''") + "')" for x in LEAKS)
LINT_SQL = " UNION ALL ".join(
    f"SELECT doc, line_no, '{rule}' AS rule, CASE WHEN cm THEN 'warn' ELSE '{sev}' END AS severity, trim(line) AS excerpt, '{R.LINT_ADVICE[rule][0]}' AS why, '{R.LINT_ADVICE[rule][1]}' AS fix FROM ln WHERE regexp_matches(line, '{pat.replace(chr(39), chr(39) * 2)}')" + (f" AND NOT regexp_matches(line, '(?i)train')" if ex else "")
    for rule, sev, pat, ex in R.LINT_RULES
)
LINES = f"""lk AS (SELECT line, row_number() OVER () - 1 AS k FROM (VALUES {LIT}) v(line)),
dt AS (SELECT doc_id AS doc, text || chr(10) || line AS text FROM documents JOIN lk ON k = doc_id % {len(LEAKS)}),
l0 AS (SELECT doc, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS line_no FROM dt),
ln AS MATERIALIZED (SELECT *, regexp_matches(trim(line), '^(#|//|\\*|/\\*|--|''''''|\"\"\")') AS cm FROM l0)"""


def leaky_texts(spark, d):
    """Whole document texts, each followed by one line from a fixed set of leaky and clean ones."""
    line = F.get(F.array(*[F.lit(x) for x in LEAKS]), (c("doc_id") % len(LEAKS)).cast("int"))
    return table(spark, d, "documents").select(c("doc_id").alias("doc"), F.concat("text", F.lit("\n"), line).alias("text"))


@query("pred_lookahead_lint", f"WITH {LINES} {LINT_SQL}")
def _(spark, d):
    return tidy(R.lint_lines(R.source_lines(leaky_texts(spark, d), "doc")), "doc", "line_no", "rule", "severity", "excerpt", "why", "fix")


GR = """rq AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS account, CASE WHEN o_orderkey % 3 = 0 THEN 'paper' ELSE 'live' END AS mode, o_orderpriority AS symbol, o_totalprice AS notional, o_orderdate AS requested_at FROM orders),
gt AS (SELECT c_custkey AS account, c_name AS grant_id, CASE WHEN c_custkey % 10 = 0 THEN 'paper' ELSE 'live' END AS grant_mode, TIMESTAMP '1996-06-01' + to_days((c_custkey % 700)::INT) AS valid_until, CASE c_custkey % 3 WHEN 0 THEN ['*'] WHEN 1 THEN ['1-urgent', '2-HIGH'] ELSE ['5-LOW'] END AS syms, 100000 + c_custkey * 700 AS cap FROM customer)"""


@query("pred_grant_rules", f"""WITH {GR}, z AS (SELECT rq.*, gt.* EXCLUDE (account), CASE WHEN mode = 'paper' THEN 'paper' WHEN grant_id IS NULL THEN 'no_grant' WHEN grant_mode <> 'live' THEN 'not_live' WHEN requested_at > valid_until THEN 'expired'
  WHEN NOT (list_contains(syms, '*') OR list_contains(list_transform(syms, lambda s: upper(s)), upper(symbol))) THEN 'symbol' WHEN notional > cap THEN 'size' ELSE 'live' END AS reason FROM rq LEFT JOIN gt USING (account)) SELECT id, reason, reason IN ('paper', 'live') AS allowed FROM z""")
def _(spark, d):
    req = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 7 == 0, -c("o_custkey")).otherwise(c("o_custkey")).alias("account"), F.when(c("o_orderkey") % 3 == 0, "paper").otherwise("live").alias("mode"), c("o_orderpriority").alias("symbol"),
                                           c("o_totalprice").alias("notional"), c("o_orderdate").alias("requested_at"))
    k = c("c_custkey")
    lists = F.when(k % 3 == 0, F.array(F.lit("*"))).when(k % 3 == 1, F.array(F.lit("1-urgent"), F.lit("2-HIGH"))).otherwise(F.array(F.lit("5-LOW")))
    until = (F.date_add(F.lit("1996-06-01").cast("date"), (k % 700).cast("int"))).cast("timestamp_ntz")
    grants = table(spark, d, "customer").select(k.alias("account"), c("c_name").alias("grant_id"), F.when(k % 10 == 0, "paper").otherwise("live").alias("grant_mode"), until.alias("valid_until"), lists.alias("allowed_symbols"), (100000 + k * 700).alias("max_position"))
    return R.grant_rules(req, grants).select("id", "reason", "allowed")


# ---- stores ----------------------------------------------------------------------------------

TH = """th AS (SELECT p_partkey AS id, p_brand AS symbol, CASE p_size % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'validated' ELSE 'invalidated' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, string_split(p_type, ' ') AS tags FROM part)"""


def theses(spark, d):
    k = c("p_size") % 3
    return table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("symbol"), F.when(k == 0, "active").when(k == 1, "validated").otherwise("invalidated").alias("status"),
                                          F.when(c("p_partkey") % 2 == 0, "long").otherwise("short").alias("direction"), F.split("p_type", " ").alias("tags"))


@query("agg_tag_counts", f'WITH {TH}, t AS (SELECT unnest(tags) AS tag FROM th) SELECT tag, count(*) AS "count" FROM t GROUP BY tag')
def _(spark, d):
    return R.tag_counts(theses(spark, d))


@query("pred_thesis_query", f"WITH {TH} SELECT id, symbol FROM th WHERE status = 'active' AND direction = 'long' AND list_contains(list_transform(tags, lambda x: lower(x)), (SELECT lower(string_split(min(p_type), ' ')[1]) FROM part))")
def _(spark, d):
    p = table(spark, d, "part")
    tag = F.lower(F.split(F.min("p_type"), " ")[0])
    df = R.thesis_query(theses(spark, d), status="active", direction="long")
    first = p.agg(tag.alias("wanted"))  # one row
    return df.crossJoin(first).filter(F.exists("tags", lambda t: F.lower(t) == c("wanted"))).select("id", "symbol")


@query("thesis_status_log", "SELECT user_id AS thesis_id, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id")
def _(spark, d):
    log = table(spark, d, "events").select(c("user_id").alias("thesis_id"), c("event_type").alias("status"), c("ts").cast("timestamp").alias("updated_at"))
    return tidy(R.thesis_status(log))


WI = """wi AS (SELECT event_type AS symbol, CASE user_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'core' ELSE 'w' || (user_id % 50) END AS grp, CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS notes, ts AS added_at, event_id AS seq FROM events),
wu AS (SELECT upper(symbol) AS symbol, coalesce(nullif(trim(grp), ''), '自选') AS grp, nullif(arg_max(notes, (added_at, seq)), '') AS notes, min(added_at) AS added_at FROM wi GROUP BY 1, 2)"""


def watch_log(spark, d):
    k = c("user_id") % 3
    return table(spark, d, "events").select(c("event_type").alias("symbol"), F.when(k == 0, " ").when(k == 1, "core").otherwise(F.concat(F.lit("w"), (c("user_id") % 50).cast("string"))).alias("grp"),
                                            F.when(c("event_id") % 4 == 0, "").otherwise(c("props")).alias("notes"), c("ts").cast("timestamp").alias("added_at"), c("event_id").alias("seq"))


def watch_items(spark, d):
    log = watch_log(spark, d)
    early = F.lit("2024-01-10").cast("timestamp")
    return R.watch_upsert(log.filter(c("added_at") < early), log.filter(c("added_at") >= early))


@query("watch_upsert", f"WITH {WI} SELECT * FROM wu")
def _(spark, d):
    return tidy(watch_items(spark, d))


@query("watch_remove", f"WITH {WI} SELECT symbol, grp FROM wu WHERE symbol <> 'CLICK' AND NOT (symbol = 'VIEW' AND grp IN ('core', 'w5'))")
def _(spark, d):
    gone = table(spark, d, "events").select("event_type").distinct()
    out = gone.select(c("event_type").alias("symbol"), F.explode(F.array(F.lit("core"), F.lit("w5"), F.lit(None).cast("string"))).alias("grp"))
    removals = out.filter(((c("symbol") == "click") & c("grp").isNull()) | ((c("symbol") == "view") & c("grp").isNotNull()))
    return R.watch_remove(watch_items(spark, d), removals).select("symbol", "grp")


@query("run_log_retention", "WITH t AS (SELECT event_id AS run_id, event_type AS task_id, ts AS run_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT run_id, task_id, run_at FROM t QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY run_at DESC, run_id DESC) <= 15")
def _(spark, d):
    log = table(spark, d, "events").select(c("event_id").alias("run_id"), c("event_type").alias("task_id"), c("ts").cast("timestamp").alias("run_at"))
    return tidy(R.recent_runs(log, 100, 15))


@query("agg_task_actions", over(f"""SELECT 'funding' AS kind, symbol, time, abs((close - open) / nullif(close + open, 0) / 1000 * 100) >= 0.03 AS anomaly, NULL::DOUBLE AS change_pct FROM b
UNION ALL SELECT 'watch', symbol, max(time), NULL, {q('round((max(close) FILTER (rn = n) - max(close) FILTER (rn = n - 1)) / max(close) FILTER (rn = n - 1) * 100, 2)', 2)} FROM b GROUP BY symbol""", "hourly"))
def _(spark, d):
    b = bars(spark, d, "hourly")
    rates = R.funding_anomalies(b.withColumn("funding_rate", F.expr("(close - open) / nullif(close + open, 0) / 1000")))
    one = rates.select(F.lit("funding").alias("kind"), "symbol", "time", "anomaly", F.lit(None).cast("double").alias("change_pct"))
    end = b.groupBy("symbol").agg(F.max("time").alias("time"))
    two = R.watch_summary(b).join(end, "symbol").select(F.lit("watch").alias("kind"), "symbol", "time", F.lit(None).cast("boolean").alias("anomaly"), "change_pct")
    return tidy(one.unionByName(two), digits=2)


@query("format_amounts", """SELECT o_orderkey, CASE WHEN o_totalprice * 1000.003 >= 1e8 THEN printf('%.2f', o_totalprice * 1000.003 / 1e8) || '亿' WHEN o_totalprice * 1000.003 >= 1e4 THEN printf('%.1f', o_totalprice * 1000.003 / 1e4) || '万' ELSE printf('%.0f', o_totalprice * 1000.003) END AS amount,
CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END || printf('%.2f', o_totalprice / 7777.003) || '%' AS pct FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    sign = F.when(c("o_custkey") % 2 == 0, 1).otherwise(-1)
    return o.select("o_orderkey", R.compact_amount(c("o_totalprice") * 1000.003).alias("amount"), R.signed_pct(sign * c("o_totalprice") / 7777.003).alias("pct"))
