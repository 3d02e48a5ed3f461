"""Candles, quotes and symbols from the text forms venues use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.exprs import TIMEFRAME_SECONDS, fixed_digits, timeframe_seconds
from barloom.functions.exprs import col as c
from barloom.plans.blocks import KEYS, frame

CSV_SCHEMA = "time string, open double, high double, low double, close double, volume double"
OHLC = ("open", "high", "low", "close")


def _key_of_path(path, partitioned: bool):
    """Symbol and timeframe of a file's path."""
    parts = F.split(path, "/")
    if partitioned:
        return F.url_decode(F.regexp_extract(path, "/symbol=([^/]*)/", 1)), F.regexp_extract(path, "/timeframe=([^/]*)/", 1)
    return F.url_decode(F.element_at(parts, -2)), F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.csv$", 1)


def _candle_files(root: str, partitioned: bool) -> str:
    names = "{" + ",".join(TIMEFRAME_SECONDS) + "}"
    return f"{root}/symbol=*/timeframe={names}/*.csv" if partitioned else f"{root}/*/{names}.csv"


def read_candle_csv(spark: SparkSession, root: str, partitioned: bool = False) -> DataFrame:
    """``<root>/<symbol>/<timeframe>.csv``, or the folders of ``write_candle_csv`` with ``partitioned``.

    A wrong header, column count, time or number fails the job; files of other timeframes are ignored.
    """
    symbol, timeframe = _key_of_path(c("_metadata.file_path"), partitioned)
    raw = (
        spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        .schema(CSV_SCHEMA).csv(_candle_files(root, partitioned))
    )
    df = raw.select(
        symbol.alias("symbol"), timeframe.alias("timeframe"),
        F.to_timestamp("time").alias("time"), "open", "high", "low", "close", "volume",
    )
    cells = F.coalesce(*[F.when(c(x).isNull(), x) for x in ("time", *OHLC, "volume")])
    return df.withColumn("time", F.when(cells.isNull(), c("time")).otherwise(F.raise_error(F.concat(F.lit("bad cell in column "), cells))))


def list_symbols(spark: SparkSession, root: str, partitioned: bool = False) -> DataFrame:
    """Symbols and their timeframes from the names of the files under ``root``; no file is read."""
    files = spark.read.format("binaryFile").load(_candle_files(root, partitioned))
    symbol, timeframe = _key_of_path(c("path"), partitioned)
    return files.select(symbol.alias("symbol"), timeframe.alias("timeframe")).groupBy("symbol").agg(F.sort_array(F.collect_set("timeframe")).alias("timeframes"))


# Position of each field in a venue's row, its time unit and order.
LAYOUTS = {
    "ms_ohlcv": (("time", 0), ("open", 1), ("high", 2), ("low", 3), ("close", 4), ("volume", 5), ("ms", 1)),
    "sec_chlov": (("time", 0), ("open", 5), ("high", 3), ("low", 4), ("close", 2), ("volume", 6), ("ms", 1000)),
}


def kline_rows(raw: DataFrame, column="json", layout="layout", keep=KEYS) -> DataFrame:
    """Positional JSON rows to candles; the layout is a column, newest-first or oldest-first alike."""
    row = raw.withColumn("_a", F.from_json(c(column), "array<string>"))

    def pick(field: str) -> Column:
        out = None
        for name, spec in LAYOUTS.items():
            at = dict(spec)[field]
            value = F.get("_a", F.lit(at)).try_cast("double")
            out = F.when(c(layout) == name, value) if out is None else out.when(c(layout) == name, value)
        return out

    unit = F.when(c(layout) == "sec_chlov", 1000).otherwise(1)
    time = F.timestamp_millis((pick("time") * unit).cast("long"))
    return row.select(*keep, time.alias("time"), *[pick(x).alias(x) for x in (*OHLC, "volume")])


def local_time(text) -> Column:
    """Shanghai wall clock to UTC; a bare date is the 09:30 open."""
    t = F.regexp_replace(F.trim(c(text)), "h", ":")
    whole = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(" 09:30:00")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}$"), F.concat(t, F.lit(":00")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}$"), t)
    )
    stamp = F.try_to_timestamp(F.regexp_replace(whole, r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(whole.isNotNull(), F.to_utc_timestamp(stamp, "Asia/Shanghai")).otherwise(F.try_to_timestamp(t))


def close_label_shift(timeframe="timeframe", time="time") -> Column:
    """Bars labelled by their close get their open time; only intraday frames up to an hour."""
    intraday = c(timeframe).isin("1m", "5m", "15m", "30m", "1h")
    return F.when(intraday, F.timestamp_micros(F.unix_micros(c(time)) - timeframe_seconds(timeframe) * 1000000)).otherwise(c(time))


def cn_kline_text(raw: DataFrame, column="line", source="source", keep=KEYS) -> DataFrame:
    """``time,open,close,high,low,volume`` lines; one source counts lots of a hundred shares."""
    parts = F.split(c(column), ",")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    unit = F.when(c(source) == "lots", 100.0).otherwise(1.0)
    return raw.select(
        *keep, local_time(F.get(parts, F.lit(0))).alias("time"), number(1).alias("open"), number(3).alias("high"),
        number(4).alias("low"), number(2).alias("close"), (number(5) * unit).alias("volume"),
    )


def finite_bars(bars: DataFrame) -> DataFrame:
    """Drop rows whose time or prices did not parse."""
    ok = c("time").isNotNull()
    for x in OHLC:
        ok = ok & c(x).isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))
    return bars.filter(ok)


def validate_bars(bars: DataFrame, block=None) -> DataFrame:
    """Numbered bars with the broken rule per row, null when the row is sound."""
    f = frame(bars, 1, block=block)
    before = f.lag("time")
    fault = (
        F.when(c("high") < F.greatest("open", "close"), "high")
        .when(c("low") > F.least("open", "close"), "low")
        .when(before >= c("time"), "time")
    )
    return f.add(fault=fault).rows()


def require_valid(bars: DataFrame) -> DataFrame:
    """The same rows; the job fails on the first broken one."""
    df = validate_bars(bars)
    return df.withColumn("fault", F.when(c("fault").isNull(), c("fault")).otherwise(F.raise_error(F.concat(F.lit("invalid bar: "), c("fault"))))).drop("fault")


def broker_bars(raw: DataFrame, keep=KEYS) -> DataFrame:
    """Broker bars: blank and untraded placeholder rows dropped, epoch stamps preferred over wall clocks.

    Columns: is_blank, timestamp (epoch seconds), wall, zone, open, high, low, close, volume, turnover.
    """
    zero = lambda x: F.coalesce(c(x), F.lit(0.0)) == 0
    flat = (c("open") == c("high")) & (c("open") == c("low")) & (c("open") == c("close"))
    placeholder = zero("volume") & zero("turnover") & F.coalesce(flat, F.lit(False))
    stamped = F.when(c("timestamp") > 0, F.timestamp_millis(F.floor(c("timestamp") * 1000 + 0.5).cast("long")))
    clock = F.to_utc_timestamp(F.try_to_timestamp("wall", F.lit("yyyy-MM-dd HH:mm:ss")), c("zone"))
    df = raw.filter(~F.coalesce(c("is_blank"), F.lit(False)) & ~placeholder)
    broken = F.coalesce(*[F.when(c(x).isNull() | F.isnan(c(x)), x) for x in OHLC])
    time = F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("non-numeric price: "), broken))).otherwise(F.coalesce(stamped, clock))
    return df.select(*keep, time.alias("time"), *OHLC, F.coalesce(c("volume"), F.lit(0.0)).alias("volume"))


FUNDAMENTALS = ("pe_ttm", "pb", "circulating_cap", "market_cap", "turnover_ratio")


def quote_book(raw: DataFrame, column="line", keep=("symbol",), zero_missing=(*FUNDAMENTALS, "mid")) -> DataFrame:
    """Five-level book and fundamentals from a ``~`` separated quote line; lots are 100 shares.

    A zero stands for a missing value in the fundamentals named in ``zero_missing``, and with ``mid`` in the last price, which is the middle without a book.
    """
    body = F.coalesce(F.nullif(F.regexp_extract(c(column), '"([^"]+)"', 1), F.lit("")), c(column))
    parts = F.split(body, "~")
    text = lambda k: F.get(parts, F.lit(k))
    number = lambda k: text(k).try_cast("double")
    some = lambda x: F.nullif(x, F.lit(0.0))

    def levels(first: int) -> Column:
        rows = [
            F.struct(F.coalesce(number(k), F.lit(0.0)).alias("price"), (F.coalesce(number(k + 1), F.lit(0.0)) * 100).alias("quantity"))
            for k in range(first, first + 10, 2)
        ]
        return F.filter(F.array(*rows), lambda x: x["price"] > 0)

    t = text(30)
    clock = F.when(F.length(t) == 14, F.regexp_replace(t, r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})", "$1-$2-$3 $4:$5:$6"))
    df = raw.select(*keep, local_time(clock).alias("time"), levels(9).alias("bids"), levels(19).alias("asks"),
                    number(3).alias("_last"), number(39).alias("_pe"), number(46).alias("_pb"), number(44).alias("_circ"), number(45).alias("_cap"), number(38).alias("_turn"))
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    values = dict(zip(FUNDAMENTALS, (c("_pe"), c("_pb"), c("_circ") * 1e8, c("_cap") * 1e8, c("_turn"))))
    return df.select(
        *keep, "time", "bids", "asks", F.coalesce((bid + ask) / 2, some(c("_last")) if "mid" in zero_missing else c("_last")).alias("mid"),
        fixed_digits(ask - bid, 4).alias("spread"), *[(some(v) if n in zero_missing else v).alias(n) for n, v in values.items()],
    )


MONEY_ROW = "array<struct<opendate:string,netamount:string,r0_net:string,ratioamount:string>>"


def money_flow(raw: DataFrame, column="json", keep=("symbol",)) -> DataFrame:
    """Newest row of a newest-first money-flow list; the ratio becomes a percent."""
    row = F.get(F.from_json(c(column), MONEY_ROW), F.lit(0))
    number = lambda x: row[x].try_cast("double")
    return raw.select(
        *keep, local_time(row["opendate"]).alias("time"), number("netamount").alias("net_inflow"),
        number("r0_net").alias("super_large_inflow"), fixed_digits(number("ratioamount") * 100).alias("main_ratio_pct"),
    ).filter("net_inflow is not null and time is not null")


# ---- symbols ---------------------------------------------------------------------------------

# Quotes a pair may end with.
QUOTES = ("USDT", "USDC", "BUSD", "FDUSD", "BTC", "ETH")


def stripped(symbol) -> Column:
    return F.regexp_replace(F.upper(F.trim(c(symbol))), r"[/_\-\s]", "")


def has_quote(s: Column) -> Column:
    out = F.lit(False)
    for x in QUOTES:
        out = out | ((F.length(s) > len(x)) & s.endswith(x))
    return out


def norm_symbol(symbol) -> Column:
    """Pair name with separators removed, swapped USDT letters fixed and USDT appended when no quote is there."""
    s = stripped(symbol)
    s = F.when(F.length(s) > 3, F.regexp_replace(s, "(UDST|USTD|UTSD)$", "USDT")).otherwise(s)
    return F.when((s == "") | has_quote(s), s).otherwise(F.concat(s, F.lit("USDT")))


def closest_symbol(asked: DataFrame, listed: DataFrame, symbol="symbol", limit=3) -> DataFrame:
    """Nearest listed symbol with fewer than ``limit`` edits, as a hint.

    Candidates share a piece: of ``limit`` cuts of the asked text at least one survives fewer than
    ``limit`` edits, at a position shifted by less than ``limit``. So pairs come from an equi join on
    pieces, not from all pairs.
    """
    s = stripped(symbol)
    clean = F.when(F.length(s) > 3, F.regexp_replace(s, "(UDST|USTD|UTSD|USD)$", "USDT")).otherwise(s)
    full = F.when(clean.endswith("USDT"), clean).otherwise(F.concat(clean, F.lit("USDT")))
    asks = asked.select(c(symbol).alias("asked"), F.explode(F.array_distinct(F.array(clean, full))).alias("word")).distinct()

    def cuts(word):
        size = F.greatest(F.floor(F.length(word) / limit).cast("int"), F.lit(1))
        starts = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: k * size + 1)
        # The last piece takes the remainder.
        return starts, size

    starts, size = cuts(c("word"))
    pieces = F.transform(
        starts,
        lambda at: F.struct(at.alias("at"), F.substring(c("word"), at, F.when(at == size * (limit - 1) + 1, F.length("word")).otherwise(size)).alias("piece")),
    )
    left = asks.withColumn("p", F.explode(pieces)).select("asked", "word", "p.at", "p.piece")
    shifts = left.withColumn("at", F.explode(F.sequence(c("at") - (limit - 1), c("at") + (limit - 1)))).filter("at >= 1")
    shifts = shifts.withColumn("size", F.length("piece"))
    names = listed.select(c(symbol).alias("name")).distinct()
    # A listed name offers its substrings of every length an asked word was cut into.
    most = F.length("name")
    grams = names.withColumn("size", F.explode(F.sequence(F.lit(1), most))).withColumn("at", F.explode(F.sequence(F.lit(1), most - c("size") + 1)))
    grams = grams.withColumn("piece", F.expr("substring(name, at, size)"))
    pairs = shifts.join(grams, ["at", "size", "piece"]).select("asked", "word", "name").distinct()
    scored = pairs.withColumn("distance", F.levenshtein("word", "name")).filter(c("distance") < limit)
    return scored.groupBy("asked").agg(F.min_by("name", F.struct("distance", "name")).alias("closest"), F.min("distance").alias("distance"))


def cn_symbol(symbol) -> Column:
    """A-share code as struct(code, market, secid, listing); null when the text is no such code."""
    s = F.upper(F.regexp_replace(F.trim(c(symbol)), r"[.\-_\s]", ""))
    front, back, bare = s.rlike(r"^(SH|SZ|BJ)\d{6}$"), s.rlike(r"^\d{6}(SH|SZ|BJ)$"), s.rlike(r"^\d{6}$")
    code = F.when(front, F.substring(s, 3, 6)).when(back | bare, F.substring(s, 1, 6))
    guess = F.when(code.rlike("^(00|30|200|399)"), "sz").when(code.rlike("^(920|43|83|87|88)"), "bj").otherwise("sh")
    market = F.when(front, F.lower(F.substring(s, 1, 2))).when(back, F.lower(F.substring(s, 7, 2))).when(bare, guess)
    secid = F.concat(F.when(market == "sh", "1.").otherwise("0."), code)
    return F.when(code.isNotNull(), F.struct(code.alias("code"), market.alias("market"), secid.alias("secid"), F.concat(market, code).alias("listing")))


def asset_class(symbol) -> Column:
    s = F.upper(c(symbol))
    share = s.rlike(r"^(SH|SZ|BJ)?\d{6}$")
    coin = s.rlike("(USDT|USDC|BUSD|BTC|ETH|SOL|DOGE)$")
    return F.when(share, F.struct(F.lit("equity").alias("asset_class"), F.lit("CNY").alias("currency"))).when(
        coin, F.struct(F.lit("crypto").alias("asset_class"), F.lit("USDT").alias("currency"))
    ).otherwise(F.struct(F.lit("equity").alias("asset_class"), F.lit("USD").alias("currency")))


def board(symbol) -> Column:
    code = F.trim(F.regexp_replace(c(symbol), "^[a-zA-Z]+", ""))
    return F.when(code.startswith("688"), "star").when(code.startswith("30"), "chi_next").when(code.rlike("^(8|4|92)"), "bse").otherwise("main")


def is_pair_symbol(symbol) -> Column:
    """Whether the crypto source claims a symbol: a known quote and no exchange prefix or share code."""
    raw = F.upper(F.trim(c(symbol)))
    s = stripped(symbol)
    foreign = raw.rlike(r"^(HK|US|SH|SZ|CC)\.") | s.rlike(r"^\d{6}$") | s.rlike(r"^(SH|SZ|BJ)\d{6}$") | s.rlike(r"^\d{6}(SH|SZ|BJ)$")
    return ~foreign & has_quote(s)


def route(symbol, explicit=None, default="csv", known=("binance", "cn", "csv")) -> Column:
    """Source for a symbol: the named one, else the first that claims it, else the default.

    An unknown name gives ``error:unknown``; no default gives ``error:ambiguous``.
    """
    matched = F.when(is_pair_symbol(symbol), "binance").when(cn_symbol(symbol).isNotNull(), "cn")
    fallback = F.coalesce(matched, F.lit(default if default else "error:ambiguous"))
    if explicit is None:
        return fallback
    named = F.when(c(explicit).isin(*known), c(explicit)).otherwise("error:unknown")
    return F.when(c(explicit).isNotNull(), named).otherwise(fallback)


# Venue, market and symbol template per large-order feed.
VENUES = (
    ("Binance", "perp", "Binance_{b}USDT"),
    ("Bybit", "perp", "Bybit_{b}USDT"),
    ("Bybit", "spot", "Bybit_SPOT_{b}USDT"),
    ("Hyperliquid", "perp", "Hyperliquid_{b}-USD"),
    ("Bitget", "perp", "Bitget_{b}USDT_UMCBL"),
    ("Bitget", "spot", "Bitget_SPOT_{b}USDT"),
    ("Gate", "perp", "Gate_{b}_USDT"),
    ("Gate", "spot", "Gate_SPOT_{b}_USDT"),
    ("Aster", "perp", "Aster_{b}USDT"),
    ("Bitfinex", "perp", "Bitfinex_t{b}F0:USTF0"),
    ("Bitfinex", "spot", "Bitfinex_SPOT_{b}USD"),
    ("Bitstamp", "spot", "Bitstamp_SPOT_{b}USD"),
    ("Kraken", "spot", "Kraken_SPOT_{b}/USD"),
)


def venue_symbols(pairs: DataFrame, pair="pair", market=None) -> DataFrame:
    """Feed symbols of a pair on every venue: each row carries a fixed list of thirteen templates."""
    base = F.regexp_replace(c(pair), "(USDT|USDC|FDUSD|BUSD|USD)$", "")
    chosen = [v for i, v in enumerate(VENUES) if i == 0 or market is None or v[1] == market]
    rows = F.array(*[F.struct(F.lit(v).alias("venue"), F.lit(m).alias("market"), F.lit(t).alias("template")) for v, m, t in chosen])
    df = pairs.withColumn("v", F.explode(rows)).withColumn("_b", base)
    coin = F.when((c("v.venue") == "Kraken") & (c("_b") == "BTC"), "XBT").otherwise(c("_b"))
    return df.select(*pairs.columns, "v.venue", "v.market", F.replace(c("v.template"), F.lit("{b}"), coin).alias("feed_symbol"))
