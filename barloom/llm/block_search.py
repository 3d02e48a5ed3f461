"""Exact top-k inner products by pruning blocks of vectors.

Components become integers. Vectors are put in an order that keeps like ones together (by the nearest of some pivots,
a bounded sample that only shapes the blocks) and cut into blocks. A block carries its vectors' largest and smallest
value of each component, and the vectors themselves as its forward index. For a query, the larger of q * largest and
q * smallest, summed over the components, bounds every score inside the block.

The blocks of a query are taken in the order of their bounds, in rounds: the first ``ROUNDS[0]``, then up to
``ROUNDS[1]``, then all others, each time only those whose bound reaches the k-th score so far. Bounds are computed from
the blocks' extremes alone, page against page; only surviving (query, block) pairs meet the vectors, by a join on the
block, with the queries of a much wanted block dealt in packets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import map_arrow
from barloom.session import cut_lineage

EVERY = 50
K = 5
ROWS = 128
PIVOTS = 1024
ROUNDS = (2, 16)
QUERY_PAGE, BLOCK_PAGE, PACKET = 512, 1024, 512
_LARGEST = 1.7e308
_LONG = (-(2**63), 2**63 - 1)


class Numbers:
    """Numbers that no other task of the stage gives, the same when a task is run again."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 40

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers held as doubles, in 16 bits where all fit; the first byte tells."""
    small = not x.size or np.abs(x).max() < 1 << 15
    return bytes([int(small)]) + x.astype("<i2" if small else "<f8").tobytes()


def unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if data[0] else "<f8", offset=1).astype(float).reshape(-1, dim) if dim else np.zeros((0, 0))


def _fits(a: np.ndarray, b: np.ndarray) -> float:
    return (np.abs(a).max() if a.size else 0.0) * (np.abs(b).max() if b.size else 0.0) * max(a.shape[1], 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as 64-bit integers; beyond that range they are held at its ends."""
    largest = _fits(a, b)
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    if largest < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, *_LONG).astype(np.int64)


def _integers(batches):
    numbers = Numbers()
    for batch in batches:
        col = batch.column("embedding")
        lengths = np.array([-1 if n is None else n for n in pc.list_value_length(col).to_pylist()], np.int64)
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
        ends = np.cumsum(np.maximum(lengths, 0))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        with np.errstate(over="ignore"):
            flat = np.clip(np.floor(flat * 256), -_LARGEST, _LARGEST)
        ids = batch.column("vec_id").to_pylist()
        keep = [k for k, (n, e) in enumerate(zip(lengths, ends)) if n >= 0 and bad[e] == bad[e - n]]
        yield numbers.take(len(keep)), [ids[k] for k in keep], lengths[keep], [pack(flat[ends[k] - lengths[k] : ends[k]]) for k in keep]


def _matrix(column, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.vstack([unpack(x, dim) for x in rows]) if dim and rows else np.zeros((len(rows), dim))


def _near_pivot(pivots):
    units = {}
    for dim, x in pivots:
        v = unpack(x, dim).ravel()
        units.setdefault(dim, []).append(v / max(np.abs(v).max(initial=0.0), 1.0))
    units = {dim: np.vstack(v) / np.maximum(np.linalg.norm(np.vstack(v), axis=1), 1e-300)[:, None] for dim, v in units.items() if dim}

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            pivot, near = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in units:
                    to = _matrix(batch.column("x").take(pa.array(at)), dim) / 256 @ units[dim].T
                    pivot[at], near[at] = to.argmax(1), to.max(1)
            yield *(batch.column(c) for c in ("number", "vec_id", "dim", "x")), pivot, near

    return run


BLOCKS = "block long, dim int, numbers array<long>, ids array<long>, x binary, high binary, low binary"


def _blocks(batches):
    """Blocks of sorted rows: up to ``ROWS`` of one pivot."""
    numbers, key, held = Numbers(), None, []

    def flush():
        held.sort(key=lambda r: (r[1] is None, r[1] or 0))
        x = _matrix(pa.array([r[2] for r in held], pa.binary()), key[0])
        high, low = (x.max(0), x.min(0)) if key[0] else (x[:0], x[:0])
        return numbers.take(1), [key[0]], [[r[0] for r in held]], [[r[1] for r in held]], [pack(x)], [pack(high)], [pack(low)]

    for batch in batches:
        for dim, pivot, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", "pivot", "number", "vec_id", "x"))):
            if held and ((dim, pivot) != key or len(held) == ROWS):
                yield flush()
                held = []
            key = dim, pivot
            held.append(row)
    if held:
        yield flush()


def _pages(size: int, names: tuple[str, ...]):
    """Rows of one dim gathered ``size`` at a time: (page, dim, an array of each name)."""

    def run(batches):
        numbers, held = Numbers(), {}
        for batch in batches:
            for dim, *row in zip(*(batch.column(c).to_pylist() for c in ("dim", *names))):
                held.setdefault(dim, []).append(row)
                if len(held[dim]) == size:
                    yield numbers.take(1), [dim], *([list(c)] for c in zip(*held.pop(dim)))
        for dim, rows in held.items():
            yield numbers.take(1), [dim], *([list(c)] for c in zip(*rows))

    return run


def _bounds(best: int | None):
    """(query, block, bound): each query's ``best`` blocks of a page, or all blocks that reach its k-th score."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q, high, low = (_matrix(pa.array(row[c], pa.binary()), dim) for c in ("x", "high", "low"))
                if max(_fits(q, high), _fits(q, low)) < 2**53:
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                else:  # too large for exact doubles: such blocks are never passed over
                    bound = np.full((len(q), len(high)), np.inf)
                if best is None:
                    i, j = np.nonzero(bound >= np.array(row["least"])[:, None])
                else:
                    j = np.argsort(-bound, axis=1, kind="stable")[:, :best]
                    i, j = np.repeat(np.arange(len(q)), j.shape[1]), j.ravel()
                yield np.array(row["query"])[i], np.array(row["block"])[j], bound[i, j]

    return run


def _scores(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, numbers, ids = row["dim"], np.array(row["numbers"]), row["ids"]
                x = unpack(row["x"], dim) if dim else np.zeros((len(ids), 0))
                queries = np.array([q["query"] for q in row["queries"]])
                q = _matrix(pa.array([q["q"] for q in row["queries"]], pa.binary()), dim)
                score = products(q, x)
                own = queries[:, None] == numbers
                # vectors stand by id, so a stable sort puts ties to the smaller id; the query's own row goes last
                order = np.lexsort((np.broadcast_to(np.arange(len(ids)), score.shape), -np.clip(score, -(2**63) + 1, None), own), axis=1)[:, :k]
                i = np.repeat(np.arange(len(q)), order.shape[1])
                j = order.ravel()
                other = ~own[i, j] & (score[i, j] >= np.array([_LONG[0] if q["least"] is None else q["least"] for q in row["queries"]])[i])
                i, j = i[other], j[other]
                yield queries[i], [ids[m] for m in j], score[i, j]

    return run


def nearest_vectors(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The ``k`` highest integer inner products of each query row: query_id, rank, vec_id, score.

    Queries are the rows of ``embeddings`` (vec_id, embedding) whose vec_id is divisible by ``every``; candidates are all rows but
    the query's own (a row that repeats its id or vector is a candidate, and a query of its own). Ties go to the smaller
    vec_id, null ids last. A vector that is null or holds a null or non-finite component takes no part; vectors of
    different lengths never meet; empty vectors score 0 with each other. Scores beyond 64 bits are held at the range's
    ends. Other columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    members = cut_lineage(map_arrow(embeddings.select("vec_id", "embedding"), _integers, "number long, vec_id long, dim int, x binary"))
    pivots = min(PIVOTS, math.isqrt(members.count()) + 1)
    sample = [(r["dim"], bytes(r["x"])) for r in members.orderBy(F.xxhash64("number"), "number").limit(pivots).collect()]
    placed = map_arrow(members, _near_pivot(sample), "number long, vec_id long, dim int, x binary, pivot long, near double")
    order = ["dim", "pivot", "near", "number"]
    blocks = cut_lineage(map_arrow(placed.repartitionByRange(*order).sortWithinPartitions(*order), _blocks, BLOCKS))
    queries = cut_lineage(members.filter(F.col("vec_id") % every == 0).select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"), "dim", "x"))
    pages = cut_lineage(map_arrow(blocks.select("dim", "block", "high", "low"), _pages(BLOCK_PAGE, ("block", "high", "low")), "page long, dim int, block array<long>, high array<binary>, low array<binary>"))
    parts = max(1, min(pages.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sides = pages.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(parts))).drop("page")

    def bounds(asked: DataFrame, best: int | None) -> DataFrame:
        """Query pages against block pages of their dim, page by page; every part of the block pages sees each query page once."""
        paged = map_arrow(asked.select("dim", "query", "x", "least"), _pages(QUERY_PAGE, ("query", "x", "least")), "page long, dim int, query array<long>, x array<binary>, least array<double>")
        paged = paged.drop("page").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return cut_lineage(map_arrow(paged.join(sides, ["dim", "part"]), _bounds(best), "query long, block long, bound double"))

    def score(pairs: DataFrame, best: DataFrame | None = None) -> DataFrame:
        """Each block's best for its queries; with ``best``, only what reaches the k-th score so far."""
        pairs = cut_lineage(pairs.select("query", "block"))
        wanted = cut_lineage(pairs.groupBy("block").agg(F.ceil(F.count("*") / PACKET).alias("packets")))
        dealt = pairs.join(wanted, "block").join(queries.select("query", F.col("x").alias("q")), "query")
        kth = F.lit(None).cast("long") if best is None else F.col("kth")
        if best is not None:
            dealt = dealt.join(best.filter(F.col("rank") == k).select("query", F.col("score").alias("kth")), "query", "left")
        packets = dealt.groupBy("block", F.pmod(F.xxhash64("query"), "packets").alias("packet")).agg(F.collect_list(F.struct("query", "q", kth.alias("least"))).alias("queries"))
        return map_arrow(packets.join(blocks, "block").select("dim", "numbers", "ids", "x", "queries"), _scores(k), "query long, vec_id long, score long")

    def best_of(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        return cut_lineage(found.withColumn("rank", rank).filter(F.col("rank") <= k))

    def least(best: DataFrame) -> DataFrame:
        return best.filter(F.col("rank") == k).select("query", F.col("score").cast("double").alias("least"))

    nothing = F.lit(float("-inf"))
    by_bound = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    first = bounds(queries.withColumn("least", nothing), ROUNDS[0]).withColumn("place", by_bound).filter(F.col("place") <= ROUNDS[0])
    first = cut_lineage(first.select("query", "block"))
    best = best_of(score(first))
    asked = queries.join(least(best), "query", "left").withColumn("least", F.coalesce("least", nothing))
    left = bounds(asked, None).join(first, ["query", "block"], "left_anti").withColumn("place", by_bound)
    left = cut_lineage(left)
    early, late = F.col("place") <= ROUNDS[1], F.col("place") > ROUNDS[1]
    best = best_of(best.drop("rank").union(score(left.filter(early), best)))
    rest = left.filter(late).join(least(best), "query", "left").filter("least is null or bound >= least")
    best = best_of(best.drop("rank").union(score(rest, best)))
    return best.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")


#: The same rows in SQL: every query against every row.
SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.r <> v.r AND len(q.e) = len(v.e)),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {K}
"""
