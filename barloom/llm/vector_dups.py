"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Equal vectors are collapsed first. In each table a vector's bucket is the signs of its products with some random
hyperplanes; vectors of one bucket are compared by exact cosine in double precision, block against block. A pair
that meets in several tables counts in the first of them only. Blocks give link counts per vector and a spanning
forest of their links, never the pairs; the forests meet in distributed connected components.

The number of planes follows the logarithm of the number of vectors, and the number of tables is such that a pair
at the limit meets at least once with probability ``RECALL``; closer pairs meet more often.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, map_arrow
from barloom.session import cut_lineage

LIMIT = 0.9
RECALL = 0.97
BUCKET = 16
BLOCK = 1024


def sizes(vectors: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """(planes per table, tables) for so many vectors; about ``BUCKET`` unrelated vectors share a bucket."""
    planes = min(30, max(8, math.ceil(math.log2(max(vectors, 1) / BUCKET))))
    meet = (1 - math.acos(limit) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _units(batch):
    """Per row a unit vector in double precision, or None where it links with nothing."""
    for v in batch:
        x = None if v is None or None in v else np.array(v, float)
        if x is None or not len(x) or not np.isfinite(x).all():
            yield None
            continue
        top = np.abs(x).max()
        if not top:
            yield None
            continue
        x = x / top  # no overflow or underflow in the norm
        yield x / np.sqrt(x @ x)


def _keys(batches):
    for batch in batches:
        keys, units = [], []
        for x in _units(batch.column("embedding").to_pylist()):
            units.append(None if x is None else x.astype("<f8").tobytes())
            keys.append(None if x is None else hashlib.md5(units[-1]).digest())
        yield batch.column("vec_id"), keys, units


def _hashed(planes: int, tables: int):
    def run(batches):
        hyperplanes: dict[int, np.ndarray] = {}
        for batch in batches:
            units = [np.frombuffer(u, "<f8") for u in batch.column("unit").to_pylist()]
            if not units:
                continue
            for dim in sorted({len(u) for u in units}):
                at = [i for i, u in enumerate(units) if len(u) == dim]
                if dim not in hyperplanes:
                    hyperplanes[dim] = np.random.default_rng([11, dim, planes, tables]).standard_normal((dim, planes * tables))
                bits = (np.stack([units[i] for i in at]) @ hyperplanes[dim] > 0).reshape(len(at), tables, planes)
                signs = (bits << np.arange(planes)).sum(2).astype("<u4")
                node, copies, unit = (batch.column(c).take(pa.array(at, pa.int64())) for c in ("node", "copies", "unit"))
                all_signs = [s.tobytes() for s in signs]
                for t in range(tables):
                    yield [dim] * len(at), [t] * len(at), [int(s) for s in signs[:, t]], node, copies, unit, all_signs

    return run


def _forest(rows: np.ndarray, cols: np.ndarray, size: int) -> np.ndarray:
    """The smallest place each place is connected with, by links (rows[k], cols[k])."""
    label = np.arange(size)
    while len(rows):
        before = label.copy()
        np.minimum.at(label, rows, label[cols])
        np.minimum.at(label, cols, label[rows])
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(limit: float):
    def one(table, left, right):
        """left, right: (nodes, copies, units, signs); right is None for a block against itself."""
        a, b = left, right or left
        la, lb = len(a[0]), len(b[0])
        rows, cols = [], []
        for start in range(0, la, BLOCK):
            for other in range(0, lb, BLOCK):
                near = a[2][start : start + BLOCK] @ b[2][other : other + BLOCK].T >= limit
                i, j = np.nonzero(near)
                rows.append(i + start)
                cols.append(j + other)
        i, j = np.concatenate(rows), np.concatenate(cols)
        if right is None:
            i, j = i[i < j], j[i < j]
        if table:
            new = ~(a[3][i, :table] == b[3][j, :table]).any(1)
            i, j = i[new], j[new]
        links = np.bincount(i, b[1][j], la), np.bincount(j, a[1][i], lb)
        if right is None:
            nodes, count, label = a[0], links[0] + links[1], _forest(i, j, la)
        else:
            nodes, count, label = np.concatenate([a[0], b[0]]), np.concatenate(links), _forest(i, j + la, la + lb)
        hit = count > 0
        return nodes[hit], nodes[label[hit]], count[hit].astype(np.int64)

    def run(batches):
        current, held = None, []

        def flush():
            table, i, j = current[1], current[3], current[4]
            side = lambda s: [r for r in held if r[0] == s]
            left, right = side(i), None if i == j else side(j)
            if not left or right == [] or (right is None and len(left) < 2):
                return None
            arrays = [
                None if x is None else (np.array([r[1] for r in x]), np.array([r[2] for r in x], float), np.stack([np.frombuffer(r[3], "<f8") for r in x]), np.stack([np.frombuffer(r[4], "<u4") for r in x]))
                for x in (left, right)
            ]
            return one(table, *arrays)

        names = ("dim", "t", "sign", "i", "j", "part", "node", "copies", "unit", "signs")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:5] != current:
                    if current and (out := flush()):
                        yield out
                    current, held = row[:5], []
                held.append(row[5:])
        if current and (out := flush()):
            yield out

    return run


def link_vectors(embeddings: DataFrame, limit: float = LIMIT, recall: float = RECALL) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
    different lengths never link. Repeated rows count as vectors of their own. A null vec_id is kept: its component is
    the smallest id it reaches, or null. Other columns are ignored; an empty table gives an empty result.
    """
    members = cut_lineage(map_arrow(embeddings.select("vec_id", "embedding"), _keys, "vec_id long, key binary, unit binary"))
    distinct = members.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    distinct = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    planes, tables = sizes(distinct.count(), limit, recall)
    hashed = map_arrow(distinct.select("node", "copies", "unit"), _hashed(planes, tables), "dim int, t int, sign long, node long, copies long, unit binary, signs binary")
    hashed = cut_lineage(hashed)
    bucket = ["dim", "t", "sign"]
    crowded = hashed.groupBy(*bucket).count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / BLOCK))
    # a crowded bucket is dealt in parts, and every pair of parts is compared on its own
    placed = hashed.join(cut_lineage(crowded.select(*bucket, "parts")), bucket).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = pairs.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")}).drop("with", "parts")
    keys = [*bucket, "i", "j"]
    found = cut_lineage(map_arrow(pairs.select(*keys, "part", "node", "copies", "unit", "signs").repartition(*keys).sortWithinPartitions(*keys), _compare(limit), "node long, other long, n long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut_lineage(named.select("key", "low", "copies", "root", F.coalesce("n", F.lit(0)).alias("n")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    per_key = cut_lineage(named.join(lowest, "root").select("key", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"))
    rows = members.select("vec_id", "key").join(per_key, "key", "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
