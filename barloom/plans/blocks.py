"""Splitting one long series into bounded blocks.

One symbol may own a large share of all bars, so no window here runs over a whole key. Rows
get a global position ``rn`` from per-chunk counts; windows then run over blocks of rows that
carry a halo of neighbours, running values add a small per-block carry, and linear recurrences
use decayed block sums. All of it is built-in Spark SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import LONGEST_MONTH_SECONDS, timeframe_seconds

KEYS = ("symbol", "timeframe")
CHUNK_BARS = 4096
BLOCK_ROWS = 8192


def number_rows(df: DataFrame, keys=KEYS, order=("time",), chunk: Column | None = None) -> DataFrame:
    """Add ``rn`` (1-based position in the key) and ``n`` (rows in the key).

    Chunks are stretches of time holding at most CHUNK_BARS bars, so sorting never sees a whole
    key; only the chunk counts, some thousand times fewer, are windowed per key.
    """
    if chunk is None:
        seconds = F.coalesce(timeframe_seconds(), F.lit(LONGEST_MONTH_SECONDS))
        chunk = F.floor(F.unix_seconds("time") / (seconds * CHUNK_BARS))
    tagged = df.withColumn("_chunk", chunk)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        tagged.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
            F.sum("_size").over(by_key).alias("n"),
        )
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        tagged.join(sizes, [*keys, "_chunk"])
        .withColumn("rn", F.col("_before") + F.row_number().over(in_chunk))
        .drop("_chunk", "_before")
    )


# exp(-FADE) is about 1e-50: what lies further back cannot reach a double's last digit.
FADE = 115.0
OVERFLOW = 650.0


def fade_rows(rate: float) -> int:
    """Rows after which a recurrence with this rate has forgotten its past."""
    return math.ceil(FADE / -math.log(rate)) if rate > 0 else 1


class Framed:
    """Rows cut into blocks, each with copies of its neighbours' nearest rows.

    All windows of a chain share the one shuffle that made the blocks. Columns whose names start
    with an underscore are scratch and vanish with the halo.
    """

    def __init__(self, df: DataFrame, keys, most: int):
        self.df = df
        self.keys = tuple(keys)
        self.parts = (*self.keys, "_blk")
        self.most = most

    @property
    def window(self):
        return Window.partitionBy(*self.parts).orderBy("rn")

    @property
    def upto(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, rows: int):
        """The current row and the rows - 1 before it."""
        return self.window.rowsBetween(-(rows - 1), 0)

    def prior(self, rows: int, skip: int = 0):
        """``rows`` rows ending ``skip + 1`` rows before the current one."""
        return self.window.rowsBetween(-(rows + skip), -(1 + skip))

    def following(self, rows: int):
        return self.window.rowsBetween(1, rows)

    def lag(self, c, k: int = 1) -> Column:
        return F.lag(c, k).over(self.window)

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(c, k).over(self.window)

    def add(self, **cols) -> "Framed":
        return Framed(self.df.withColumns(cols), self.keys, self.most)

    def scan(self, **specs) -> "Framed":
        """Solve ``y[t] = rate * y[t-1] + b[t]`` for each name=(rate, b).

        The solution is a running sum of ``b * rate**-p`` scaled by ``rate**p``. The caller's halo
        covers ``fade_rows(rate)``, so starting from nothing at the block's first row is exact to
        double precision. Fast rates would overflow over a long block; they run in sub-blocks
        whose ends are handed on by two more windows.
        """
        f = self
        if "_row_at" not in f.df.columns:
            f = f.add(_row_at=(F.row_number().over(f.window) - 1).cast("double"))
        pos = F.col("_row_at")
        feed = {f"_b_{n}": F.coalesce(b, F.lit(0.0)) for n, (_, b) in specs.items()}
        f = f.add(**feed)
        plain, sub, local, ends, final = {}, {}, {}, {}, {}
        for name, (rate, _) in specs.items():
            base, b, speed = F.lit(float(rate)), F.col(f"_b_{name}"), -math.log(rate)
            if f.most * speed <= OVERFLOW:
                plain[name] = F.pow(base, pos) * F.sum(b * F.pow(base, -pos)).over(f.upto)
                continue
            size = math.ceil(2 * FADE / speed)
            sub[f"_s_{name}"] = F.floor(pos / size)
            p = pos % size
            inside = Window.partitionBy(*self.parts, f"_s_{name}").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
            local[f"_l_{name}"] = F.pow(base, p) * F.sum(b * F.pow(base, -p)).over(inside)
            earlier = self.window.rowsBetween(Window.unboundedPreceding, -1)
            ends[f"_e_{name}"] = F.last(F.when(p == size - 1, F.col(f"_l_{name}")), ignorenulls=True).over(earlier)
            carry = F.coalesce(F.col(f"_e_{name}"), F.lit(0.0))
            final[name] = F.col(f"_l_{name}") + F.pow(base, p + 1) * carry
        for cols in (plain | sub, local, ends, final):
            if cols:
                f = f.add(**cols)
        return f

    def rows(self, *keep) -> DataFrame:
        """Every row once, without halo copies and scratch columns."""
        out = self.df.filter("_core")
        return out.drop(*[c for c in out.columns if c.startswith("_") and c not in keep])


def frame(df: DataFrame, lookback: int = 0, lookahead: int = 0, keys=KEYS, block: int | None = None) -> Framed:
    """Cut numbered rows into blocks that see ``lookback`` rows before and ``lookahead`` after.

    Blocks are at least four halos long unless ``block`` asks for less, so copies stay a small part.
    """
    size = max(block or max(BLOCK_ROWS, 4 * lookback), lookback, lookahead, 1)
    home = F.floor((F.col("rn") - 1) / size)
    offset = (F.col("rn") - 1) % size
    targets = [home]
    if lookback:
        near_end = (offset >= size - lookback) & ((home + 1) * size < F.col("n"))
        targets.append(F.when(near_end, home + 1))
    if lookahead:
        targets.append(F.when((offset < lookahead) & (home > 0), home - 1))
    out = df.withColumn("_home", home)
    if len(targets) > 1:
        out = out.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    else:
        out = out.withColumn("_blk", home)
    out = out.withColumn("_core", F.col("_blk") == F.col("_home")).drop("_home")
    return Framed(out, keys, size + lookback + lookahead)


def running(df: DataFrame, specs: dict, keys=KEYS, block: int | None = None) -> DataFrame:
    """Running values over the whole key, current row included.

    ``specs`` maps an output name to (kind, column) with kind sum, product, max, min or last, or to
    ("since", column, reset): the sum since the last row where ``reset`` held, that row excluded
    from the sum. Each block is scanned alone and receives what the blocks before it left behind.
    """
    size = block or BLOCK_ROWS
    cut = df.withColumn("_blk", F.floor((F.col("rn") - 1) / size))
    part = (*keys, "_blk")
    inside = Window.partitionBy(*part).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy(*keys).orderBy("_blk")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}
    expr = lambda c: F.col(c) if isinstance(c, str) else c
    local, second, totals, chain, carries, joined = {}, {}, [], {}, [], {}
    for name, (kind, source, *rest) in specs.items():
        c, tot, car, loc = expr(source), f"_t_{name}", f"_c_{name}", f"_l_{name}"
        a, b = F.col(loc), F.col(car)
        if kind == "since":
            reset, cnt = F.coalesce(expr(rest[0]), F.lit(False)), f"_k_{name}"
            local[cnt] = F.sum(reset.cast("int")).over(inside)
            stretch = Window.partitionBy(*part, cnt).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
            second[loc] = F.coalesce(F.sum(F.when(~reset, c)).over(stretch), F.lit(0.0))
            totals += [F.max_by(loc, "rn").alias(tot), F.max(cnt).alias(f"_h_{name}")]
            seg = f"_g_{name}"
            chain[seg] = F.sum((F.col(f"_h_{name}") > 0).cast("int")).over(by_key)
            whole = Window.partitionBy(*keys, seg).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
            chain[f"_w_{name}"] = F.sum(tot).over(whole)
            carries.append(F.lag(f"_w_{name}").over(by_key).alias(car))
            joined[name] = a + F.when(F.col(cnt) == 0, F.coalesce(b, F.lit(0.0))).otherwise(0.0)
        elif kind == "last":
            totals.append(F.max_by(c, F.when(c.isNotNull(), F.col("rn"))).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(earlier).alias(car))
            local[loc] = F.last(c, ignorenulls=True).over(inside)
            joined[name] = F.coalesce(a, b)
        else:
            fn = plain[kind]
            totals.append(fn(c).alias(tot))
            carries.append(fn(tot).over(earlier).alias(car))
            local[loc] = fn(c).over(inside)
            if kind in ("sum", "product"):
                joined[name] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b if kind == "sum" else a * b)
            else:
                joined[name] = F.greatest(a, b) if kind == "max" else F.least(a, b)
    scanned = cut.withColumns(local)
    if second:
        scanned = scanned.withColumns(second)
    ends = scanned.groupBy(*part).agg(*totals)
    for name, c in chain.items():
        ends = ends.withColumn(name, c)
    carry = ends.select(*part, *carries)
    out = scanned.join(carry, list(part)).withColumns(joined)
    return out.drop("_blk", *local, *second, *[f"_c_{n}" for n in specs])


def runs(df: DataFrame, state, keys=KEYS, block: int | None = None) -> DataFrame:
    """Maximal runs of equal non-null ``state``: one row per run with first and last position."""
    s = F.col(state) if isinstance(state, str) else state
    fr = frame(df.withColumn("_state", s), lookback=1, keys=keys, block=block)
    starts = F.col("_state").isNotNull() & ~fr.lag("_state").eqNullSafe(F.col("_state"))
    flagged = fr.add(_start=F.when(starts, F.col("rn"))).rows("_start", "_state")
    tagged = running(flagged, {"_run": ("last", "_start")}, keys, block)
    # A run may be as long as its key, so it is only ever reduced, never gathered.
    return (
        tagged.filter("_state is not null")
        .groupBy(*keys, F.col("_run").alias("start"))
        .agg(
            F.max("rn").alias("end"),
            F.first("_state").alias("state"),
            F.min("time").alias("start_time"),
            F.max("time").alias("end_time"),
        )
    )
