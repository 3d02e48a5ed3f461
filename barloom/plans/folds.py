"""Path-dependent operators as ordered folds over blocks.

A fold keeps a small state and reads rows in order. Every key is folded block by block in parallel:
a block starts from a guessed state (fresh, or warmed up on the rows just before it), then each
block whose guess differs from what its predecessor really left is folded again, until nothing
changes. Rows are stored by block, so a further round reads the blocks it folds again and no others.
State machines that forget settle after one or two rounds. What never forgets (money, quantities)
is kept out of the state and added up by ``plans.blocks.running``.
"""

from __future__ import annotations


import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.plans.blocks import KEYS
from barloom.session import cut_lineage

FOLD_ROWS = 65536


def _fold_batches(keys, cols, init, step, schema, emit_rows, emit_state):
    """An Arrow-batch function folding rows that arrive grouped by (keys, _blk) and sorted."""
    arrow = to_arrow_schema(schema)
    nk = len(keys)
    start_state = json.dumps(init)

    def read(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_blk", "_core", "_state", *cols)]
            yield from zip(*columns)

    def run(batches):
        out, current, state, start = [], None, None, None

        def flush():
            arrays = list(zip(*out)) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(a), type=f.type) for a, f in zip(arrays, arrow)], schema=arrow
            )

        for row in read(batches):
            group = row[: nk + 1]
            core, given, values = row[nk + 1], row[nk + 2], row[nk + 3 :]
            if group != current:
                if emit_state and current is not None and start is not None:
                    out.append((*current, start, json.dumps(state)))
                current, start = group, None
                state = json.loads(given if given is not None else start_state)
            if core and start is None:
                start = json.dumps(state)
            state, produced = step(state, values)
            if core and emit_rows:
                for p in produced:
                    out.append((*group[:nk], *p))
            if len(out) >= 4096:
                yield flush()
                out = []
        if emit_state and current is not None and start is not None:
            out.append((*current, start, json.dumps(state)))
        if out:
            yield flush()

    return run


def _fold_blocks(keys, cols, init, step, schema):
    """As ``_fold_batches``, but ``step(state, columns)`` folds a block at once; gives its states and its rows in one array."""
    arrow = to_arrow_schema(schema)
    made = [f.name for f in schema["_rows"].dataType.elementType.fields]

    def run(batches):
        for group, (*columns, given) in _whole_blocks(batches, [*keys, "_blk"], [*cols, "_state"]):
            start = json.dumps(init if given[0] is None else json.loads(given[0]))
            state, rows = step(json.loads(start), columns)
            found = (*group, start, json.dumps(state), [dict(zip(made, r)) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(found, arrow)], schema=arrow)

    return run


def ordered_fold(df: DataFrame, cols, init, step, schema: str, keys=KEYS, block: int | None = None, warmup: int = 0, guess=None, whole=False) -> DataFrame:
    """Fold numbered rows per key. With ``whole`` (and no warm-up) a step takes the numpy columns of a block and gives
    few rows; these are kept with the block's states, so that nothing is read again when all states are known.

    ``step(state, values) -> (state, rows)`` gets ``cols`` as a tuple; the state must survive a JSON
    round trip. ``schema`` describes the rows it produces, which come back with the key columns.
    ``guess`` may turn the stored rows (with _blk) into start states (keys, _blk, _state) of their blocks.
    """
    size = block or FOLD_ROWS
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + T._parse_datatype_string(schema).fields)
    needed = list(dict.fromkeys([*keys, "rn", *cols]))
    order = [*keys, "_blk", "rn"]
    stored = df.select(*needed).withColumn("_blk", F.floor((F.col("rn") - 1) / size).cast("long"))
    exact = cut_lineage(stored.repartition(*keys, "_blk"), by="_blk").withColumns({"_core": F.lit(True)})

    halo = min(warmup, size)
    first = exact.withColumn("_state", F.lit(None).cast("string")) if guess is None else exact.join(guess(exact), [*keys, "_blk"], "left")
    if halo:  # the end of a block goes before the next one as well
        ends = first.filter((F.col("rn") - 1) % size >= size - halo)
        first = first.unionByName(ends.withColumns({"_blk": F.col("_blk") + 1, "_core": F.lit(False)}))

    state_schema = T.StructType(
        key_fields + [T.StructField(n, t) for n, t in (("_blk", T.LongType()), ("_in", T.StringType()), ("_out", T.StringType()))]
    )
    if whole:
        state_schema = state_schema.add("_rows", T.ArrayType(T._parse_datatype_string(schema)))
        probe = _fold_blocks(keys, cols, init, step, state_schema)
    else:
        probe = _fold_batches(keys, cols, init, step, state_schema, False, True)

    def ordered(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(*keys, "_blk").sortWithinPartitions(*order)

    states = cut_lineage(ordered(first).mapInArrow(probe, state_schema))
    by_key = Window.partitionBy(*keys).orderBy("_blk")
    while True:
        linked = states.withColumn("_want", F.lag("_out").over(by_key))
        wrong = cut_lineage(linked.filter("_want is not null and _want <> _in").select(*keys, "_blk", F.col("_want").alias("_state")))
        if wrong.isEmpty():
            break
        redone = ordered(exact.join(wrong, [*keys, "_blk"])).mapInArrow(probe, state_schema)
        kept = states.join(wrong, [*keys, "_blk"], "left_anti")
        states = cut_lineage(kept.unionByName(redone))
    if whole:
        return states.select(*keys, F.inline("_rows"))
    begin = states.select(*keys, "_blk", F.when(F.col("_blk") > 0, F.col("_in")).alias("_state"))
    fold = _fold_batches(keys, cols, init, step, out_schema, True, False)
    return ordered(exact.join(begin, [*keys, "_blk"])).mapInArrow(fold, out_schema)


def _whole_blocks(batches, names, cols):
    """(group, columns) of each block as numpy arrays, from batches sorted by the columns ``names`` of the group."""
    current, pieces = None, []
    joined = lambda: [np.concatenate(x) for x in zip(*pieces)]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = [batch.column(x) for x in names]
        new = np.zeros(n, bool)
        new[0] = True
        for x in ids:
            new[1:] |= pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        values = [batch.column(x).to_numpy(zero_copy_only=False) for x in cols]
        cuts = [*np.flatnonzero(new).tolist(), n]
        for i, j in zip(cuts, cuts[1:]):
            group = tuple(x[i].as_py() for x in ids)
            if group != current:
                if current is not None:
                    yield current, joined()
                current, pieces = group, []
            pieces.append([v[i:j] for v in values])
    if current is not None:
        yield current, joined()


def _composed(m, g, e, d):
    """Slope and offset of a block's maps y -> (m * y + g + e) / d, one after the other, without rounding."""
    a, b = m / d, (g + e) / d
    after = np.append(np.cumprod(a[::-1])[::-1], 1.0)
    return float(after[0]), float(np.sum(b * after[1:]))


def walked(y, digits, settle, m, g, e, d):
    """Where one start stands before the first row and after each, rounded after every row."""
    unit, ys = 10**digits, [y]
    for mi, gi, ei, di in zip(m.tolist(), g.tolist(), e.tolist(), d.tolist()):
        y = (mi * y + gi + ei) / di
        t = y * unit
        whole = round(t) if abs(t) < 1e9 else t
        # next to a tie the product tells too little
        y = whole / unit if abs(t - whole) < 0.499999 and abs(t) < 1e9 else settle(y, digits)
        ys.append(y)
    return ys


def _walked_together(ys, digits, settle, m, g, e, d):
    """Where many starts end, as ``walked`` for each of them."""
    scale = float(10**digits)
    ys, whole, gap = ys.copy(), np.empty_like(ys), np.empty_like(ys)
    for mi, gi, ei, di in zip(m.tolist(), g.tolist(), e.tolist(), d.tolist()):
        ys *= mi
        ys += gi
        ys += ei
        ys /= di
        np.multiply(ys, scale, out=gap)
        np.rint(gap, out=whole)
        gap -= whole
        np.abs(gap, out=gap)
        if gap.max() > 0.5 - 1e-6 - 1e-15 * abs(whole[-1]):  # next to a tie the product tells too little
            ys = np.array([settle(y, digits) for y in ys.tolist()])
        else:
            np.divide(whole, scale, out=ys)
    return ys


def rounded_starts(exact: DataFrame, terms, settle, digits: int, keys=KEYS, spread: int = 256) -> DataFrame:
    """Where y = settle((m * y + g + e) / d, digits), row after row from zero, stands at the start of each block.

    ``terms`` are m >= 0, g, e and d; rows with a null m leave y alone. Returns (keys, _blk, y). Rounding errors add up
    along a key, so starts without rounding are off by some hundred last digits, and a start that is off stays off: mended
    one after the other, the blocks of a key would be read in sequence. Instead every block walks from its start without
    rounding; what comes out moves the starts of the blocks behind, which leaves few last digits. Then a block walks
    from ``spread`` last digits around its start at once, and the tables of all blocks are followed from zero. Three
    readings of the rows settle all blocks but for starts outside their table, which are estimates.
    """
    names, cols, unit = [*keys, "_blk"], ["_m", "_g", "_e", "_d"], 10**digits
    fields = [exact.schema[k] for k in names]
    double = lambda *xs: [T.StructField(x, T.DoubleType()) for x in xs]
    rows = exact.select(*names, "rn", *[t.cast("double").alias(x) for t, x in zip(terms, cols)])

    def per_block(rows, extra, out, fn):
        """``fn(columns) -> values`` of each block, in the columns ``out``."""
        schema = T.StructType(fields + out)
        arrow = to_arrow_schema(schema)

        def run(batches):
            for group, columns in _whole_blocks(batches, names, [*cols, *extra]):
                moved = ~np.isnan(columns[0])
                made = fn([x[moved] for x in columns[:4]], *[float(x[0]) for x in columns[4:]])
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((*group, *made), arrow)], schema=arrow)

        ordered = rows.repartition(*names).sortWithinPartitions(*names, "rn")
        return cut_lineage(ordered.mapInArrow(run, schema))

    def chained(blocks: DataFrame, steps, make) -> DataFrame:
        """``make(acc, step) -> acc`` over the blocks before each block of a key, from zero."""
        before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        y = F.aggregate(F.collect_list(F.struct(*steps)).over(before), F.lit(0.0), make)
        return blocks.select(*names, *steps, y.alias("_y"))

    maps = per_block(rows, (), double("_a", "_b"), lambda t: _composed(*t))
    plain = chained(maps, ("_a", "_b"), lambda y, s: s["_a"] * y + s["_b"]).withColumn("_y", F.round("_y", digits))
    ways = per_block(
        rows.join(cut_lineage(plain.select(*names, "_a", "_y")), names), ("_a", "_y"), double("_a", "_from", "_to"),
        lambda t, a, y: (a, y, walked(y, digits, settle, *t)[-1]),
    )
    near = chained(ways, ("_a", "_from", "_to"), lambda y, s: s["_to"] + s["_a"] * (y - s["_from"])).withColumn("_y", F.round("_y", digits))

    def table(t, a, y):
        low = round(y * unit) - spread
        ends = _walked_together((low + np.arange(2 * spread + 1)) / unit, digits, settle, *t)
        return a, low, np.rint(ends * unit).astype(np.int64).tolist()

    out = [*double("_a"), T.StructField("_low", T.LongType()), T.StructField("_ends", T.ArrayType(T.LongType()))]
    tables = per_block(rows.join(cut_lineage(near.select(*names, "_a", "_y")), names), ("_a", "_y"), out, table)

    # One table a block meets per key: some thousandth of the rows.
    found = T.StructType(fields + double("y"))
    arrow = to_arrow_schema(found)

    def follow(batches):
        for batch in batches:
            for *key, blocks in zip(*[batch.column(x).to_pylist() for x in (*keys, "_tables")]):
                y, got = 0, []
                for b in blocks:
                    got.append((*key, b["_blk"], y / unit))
                    at = min(max(y - b["_low"], 0), 2 * spread)
                    y = b["_ends"][at] + round(b["_a"] * (y - b["_low"] - at))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*got), arrow)], schema=arrow)

    by_key = tables.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_blk", "_low", "_a", "_ends"))).alias("_tables"))
    return by_key.mapInArrow(follow, found)
