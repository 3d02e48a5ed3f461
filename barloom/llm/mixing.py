"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt to blocks by a hash of their id; a source gives whole passes over its blocks and
then its first blocks until its target is met, the last of them in part. The block quotas of all sources are split
among output shards by a binary tree: a node draws, without replacement, how many of each source's blocks go to its
left half, so every shard gets an exact quota and all quotas sum to the root's. A source's blocks, in their permuted
order, fill its quotas in turn, so no block is drawn twice in a pass. Inside a shard rows are ordered by a hash.

The driver sees one row per source only. Each draw is seeded by its node, so tasks descend the tree on their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, map_arrow
from barloom.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_DOCS = 256
SHARD_BLOCKS = 64
SEED = 20240
MAX_SOURCES = 100_000
_SPAN = 1024


def targets(words: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the sum of ``words`` by weight; those above ``most`` times a source's words stop there, the excess
    goes to the others by weight until none is above."""
    out, free = [Fraction(0)] * len(words), set(range(len(words)))
    left = Fraction(sum(words))
    while free:
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * words[i]}
        for i in over or free:
            out[i] = Fraction(most * words[i]) if over else level * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


@dataclass
class SplitTree:
    """Deals ``quota[s]`` slots of each source to ``shards`` shards of equal size, give or take one slot."""

    quota: np.ndarray
    shards: int
    seed: int

    def left(self, lo: int, hi: int, quota: np.ndarray) -> np.ndarray:
        total, mid = int(self.quota.sum()), (lo + hi) // 2
        slots = mid * total // self.shards - lo * total // self.shards
        return np.random.default_rng([self.seed, lo, hi]).multivariate_hypergeometric(quota, slots, method="marginals")

    def place(self, source: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The shard of each slot: slot k of a source is the k-th block it gives."""
        out = np.zeros(len(slot), np.int64)
        open_ = [(0, self.shards, self.quota, np.arange(len(slot)), slot.astype(np.int64))]
        while open_:
            lo, hi, quota, rows, at = open_.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            left = self.left(lo, hi, quota)
            first = at < left[source[rows]]
            mid = (lo + hi) // 2
            open_.append((lo, mid, left, rows[first], at[first]))
            open_.append((mid, hi, quota - left, rows[~first], at[~first] - left[source[rows[~first]]]))
        return out


def _settle(sizes: np.ndarray, chosen: np.ndarray, rest: int) -> np.ndarray:
    """Add, drop or exchange one document at a time while that brings the sum nearer to its goal."""
    chosen = chosen.copy()
    for _ in range(64):
        inside, outside = np.flatnonzero(chosen), np.flatnonzero(~chosen)
        inside, outside = inside[np.argsort(sizes[inside], kind="stable")], outside[np.argsort(sizes[outside], kind="stable")]
        moves = [(abs(rest - sizes[o]), (o,)) for o in outside] + [(abs(rest + sizes[i]), (i,)) for i in inside]
        if len(inside):
            at = np.searchsorted(sizes[inside], sizes[outside] - rest)
            for o, k in zip(outside, at):
                moves += [(abs(rest - sizes[o] + sizes[inside[j]]), (o, inside[j])) for j in (k - 1, k) if 0 <= j < len(inside)]
        if not moves or min(m[0] for m in moves) >= abs(rest):
            break
        for k in min(moves, key=lambda m: (m[0], m[1]))[1]:
            rest += sizes[k] if chosen[k] else -sizes[k]
            chosen[k] = not chosen[k]
    return chosen


def _picks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which documents of a partly taken block: a run in hash order, then the few changes that bring its sum nearest."""
    rows = pdf.sort_values("h")
    sizes, rest = rows["size"].to_numpy(np.int64), int(pdf.rest.iloc[0])
    run = np.cumsum(sizes) <= rest
    chosen = _settle(sizes, run, rest - int(sizes[run].sum()))
    return pd.DataFrame({"idx": [pdf.idx.iloc[0]], "block": [pdf.block.iloc[0]], "picks": [[int(h) for h in rows.h.to_numpy()[chosen]]]})


class Mix:
    """The plan of a mix: which blocks, and which documents of the last block, go to which shards."""

    def __init__(self, documents: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED):
        spark = documents.sparkSession
        self.seed, self.most = seed, most
        light = cut_lineage(documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
        per_source = light.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
        found = per_source.limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"a mix takes up to {MAX_SOURCES} sources; group the rest under fewer names")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        words = [r["words"] for r in found]
        goal = targets(words, [weights[k % len(weights)] for k in range(len(found))], most)
        passes = [int(g // w) if w else 0 for g, w in zip(goal, words)]
        rest = [round(g - p * w) for g, p, w in zip(goal, passes, words)]
        blocks = [max(1, math.ceil(r["docs"] / BLOCK_DOCS)) for r in found]
        plan = [(r["source"], k, int(r["words"]), float(goal[k]), passes[k], rest[k], blocks[k]) for k, r in enumerate(found)]
        # one row a source, of which there are at most MAX_SOURCES
        self.plan = F.broadcast(spark.createDataFrame(plan, "source string, idx int, source_size long, target double, passes int, rest long, blocks int").withColumnRenamed("source", "_source"))
        self.light = light
        self._deal(spark, passes, blocks)

    def keyed(self, documents: DataFrame) -> DataFrame:
        """Documents with idx, block and h of their place in the permuted order, and the plan of their source."""
        joined = documents.join(self.plan, documents["source"].eqNullSafe(F.col("_source"))).drop("_source")
        h = F.xxhash64(F.lit(self.seed), F.coalesce("doc_id", F.lit(-1)))
        return joined.withColumn("h", h).withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed + 1), "h"), F.col("blocks")).cast("int"))

    def _deal(self, spark, passes, blocks):
        keyed = self.keyed(self.light)
        stats = keyed.groupBy("idx", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("blocks").alias("blocks"))
        stats = stats.withColumn("span", F.floor(F.col("block") / _SPAN))
        spans = stats.groupBy("idx", "span").agg(F.sum("words").alias("w"))
        before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select("idx", "span", F.coalesce(F.sum("w").over(before(["idx"], "span")), F.lit(0)).alias("base"))
        stats = stats.join(spans, ["idx", "span"]).withColumn("base", F.col("base") + F.coalesce(F.sum("words").over(before(["idx", "span"], "block")), F.lit(0)))
        part = F.when(F.col("base") + F.col("words") <= F.col("rest"), "whole").when(F.col("base") < F.col("rest"), "part").otherwise("none")
        stats = cut_lineage(stats.withColumn("kind", part))
        # at most one block of a source is taken in part
        crossing = stats.filter("kind = 'part'").select("idx", "block", (F.col("rest") - F.col("base")).alias("rest"))
        cut = keyed.drop("rest").join(crossing, ["idx", "block"]).groupBy("idx", "block", "h").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        picks = cut.groupBy("idx", "block").applyInPandas(_picks, "idx int, block int, picks array<long>")
        more = {r["idx"]: r["n"] for r in stats.filter("kind <> 'none'").groupBy("idx").agg(F.count("*").alias("n")).collect()}
        # blocks no document hashed into are no slots: slots follow each other by rank
        real = {r["idx"]: r["n"] for r in stats.groupBy("idx").agg(F.count("*").alias("n")).collect()}
        quota = np.array([passes[k] * real.get(k, 0) + more.get(k, 0) for k in range(len(passes))], np.int64)
        self.shards = max(1, math.ceil(int(quota.sum()) / SHARD_BLOCKS))
        tree = spark.sparkContext.broadcast((SplitTree(quota, self.shards, self.seed), np.array([real.get(k, 0) for k in range(len(passes))], np.int64)))
        counts = stats.groupBy("idx", "span").agg(F.count("*").alias("c"))
        counts = counts.select("idx", "span", F.coalesce(F.sum("c").over(before(["idx"], "span")), F.lit(0)).alias("rank0"))
        ranked = stats.join(counts, ["idx", "span"]).withColumn("rank", F.col("rank0") + F.row_number().over(Window.partitionBy("idx", "span").orderBy("block")) - 1)

        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                copies = np.array([r["passes"] + (r["kind"] != "none") for r in rows], np.int64)
                owner = np.repeat(np.arange(len(rows)), copies)
                copy = np.arange(len(owner)) - np.repeat(np.cumsum(copies) - copies, copies)
                idx, rank = np.array([r["idx"] for r in rows], np.int64)[owner], np.array([r["rank"] for r in rows], np.int64)[owner]
                split, size = tree.value
                shard = split.place(idx, copy * size[idx] + rank)
                parts = np.split(shard, np.cumsum(copies)[:-1]) if len(rows) else []
                yield [r["idx"] for r in rows], [r["block"] for r in rows], [r["kind"] for r in rows], [p.tolist() for p in parts]

        dealt = map_arrow(ranked.select("idx", "block", "kind", "passes", "rank"), run, "idx int, block int, kind string, shards array<int>")
        self.draws = cut_lineage(dealt.join(picks, ["idx", "block"], "left"))

    def drawn(self, documents: DataFrame) -> DataFrame:
        """Every row of ``documents`` with idx, block, h, the plan of its source, and ``shards``: where its copies go."""
        keyed = self.keyed(documents)
        placed = keyed.join(self.draws, ["idx", "block"])
        in_part = (F.col("kind") == "part") & ~F.coalesce(F.array_contains("picks", F.col("h")), F.lit(False))
        return placed.withColumn("shards", F.when(in_part, F.slice("shards", 1, F.col("passes"))).otherwise(F.col("shards")))


def mix_report(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text, source): doc_id, size, source_size, target, taken, shards.

    Sizes are words; a null or empty text has none and takes none. A null source is one source, the last; a null doc_id
    is an id of its own. Rows that repeat an id are taken together. Reruns agree. Other columns are ignored.
    """
    mix = Mix(documents)
    rows = mix.drawn(mix.light)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``documents``, one row per copy taken, shard after shard, shuffled inside each."""
    mix, names = Mix(documents), documents.columns
    body = documents.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    copies = mix.drawn(body).select("_row", "h", F.posexplode("shards").alias("_copy", "_shard"))
    placed = copies.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64(F.lit(mix.seed + 2), "h", "_copy"))
    return placed.select(*(F.col(f"_row.`{c}`").alias(c) for c in names))
