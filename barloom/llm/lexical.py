"""Ranked lexical search by two trees: exact top documents of every item.

Terms are known by 64-bit hashes. One pass over the documents keeps, per document, its number of terms and how often it
holds each term that some item may hold (a bit field of fixed size, sent to all tasks, tells which); further passes
read these vectors only. A document's coordinate for a term is its saturated frequency, an item's is the term's weight,
so a score is an inner product of two vectors without negative coordinates.

Items stand in a tree (leaves of items that share terms) and the documents of a batch in another (leaves of documents
that score alike). Every node holds its members' largest coordinate per term, so the product of two nodes bounds all
scores between their members. A pair of nodes whose bound is below the weakest k-th score so far of the items under it
is dropped as a whole; other pairs are split, down to documents and items. All numbers are integers below 2^53, so
products in doubles are exact and so are the bounds.

Each task leaves at most k documents an item; these meet in two steps. Items go to the tasks in lots of ``LOT_TERMS``
terms; each lot reads the vectors once.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, UPPER, map_arrow
from barloom.session import cut_lineage

K = 50
LOT_TERMS = 250_000
SLOTS = 1 << 20
ITEM_LEAF, DOC_LEAF, FAN = 8, 16, 8
CELLS = 1 << 22
PIECE = 1 << 22
MEMORY = 32 << 20
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms_of(text: str | None):
    """Lists of the terms of a text in its order, as bytes; long texts in pieces that end at a blank."""
    text, start = text or "", 0
    while start < len(text):
        end = text.find(" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].encode().translate(_TABLE).split()
        start = end


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) or 1


class Wanted(dict):
    """Hashes of terms that an item may hold, 0 for all others; emptied when its terms take ``MEMORY`` bytes."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.bytes = slots, 0

    def __missing__(self, term: bytes) -> int:
        self.bytes += len(term) + 200
        if self.bytes > MEMORY:
            self.clear()
            self.bytes = 0
        h = term_hash(term)
        kept = self[term] = h if self.slots[h & (SLOTS - 1)] else 0
        return kept


def _item_terms(batches):
    for batch in batches:
        found = [np.array(sorted({term_hash(t) for piece in terms_of(x) for t in piece}), np.uint64).view(np.int64) for x in batch.column("text").to_pylist()]
        yield batch.column("item_id"), found


def _vectors(slots):
    def run(batches):
        wanted = Wanted(slots.value)
        for batch in batches:
            size, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                n, parts = 0, []
                for piece in terms_of(text):
                    h = np.fromiter(map(wanted.__getitem__, piece), np.uint64, len(piece))
                    n += len(h)
                    parts.append(np.unique(h[h != 0], return_counts=True))
                if len(parts) > 1:
                    every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    parts = [(every, np.bincount(at, np.concatenate([p[1] for p in parts]), len(every)))]
                h, c = parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0))
                size.append(n)
                terms.append(h.tobytes())
                counts.append(c.astype("<i4").tobytes())
            yield batch.column("doc_id"), size, terms, counts

    return run


def _frequencies(batches):
    for batch in batches:
        found = b"".join(batch.column("terms").to_pylist())
        h, df = np.unique(np.frombuffer(found, np.int64), return_counts=True)
        yield h, df


class ItemTree:
    """Items in an order that puts those sharing terms together, cut in leaves of ``ITEM_LEAF`` and nodes of ``FAN`` leaves."""

    def __init__(self, number: np.ndarray, term: np.ndarray, weight: np.ndarray):
        """Rows (item number, term, weight), in any order; a term has one weight."""
        self.terms, column = np.unique(term, return_inverse=True)
        self.weights = np.zeros(len(self.terms))
        self.weights[column] = weight
        numbers, row = np.unique(number, return_inverse=True)
        order = np.argsort(row, kind="stable")
        columns = np.split(column[order], np.cumsum(np.bincount(row))[:-1])
        placed = self._ordered(columns)
        self.numbers = numbers[placed]
        self.columns = [columns[k] for k in placed]

    def _ordered(self, columns: list[np.ndarray]) -> list[int]:
        done, open_ = [], [np.arange(len(columns))]
        while open_:
            at = open_.pop()
            if len(at) > ITEM_LEAF:
                used, count = np.unique(np.concatenate([columns[i] for i in at]), return_counts=True)
                gain = self.weights[used] * count * (len(at) - count)
                if gain.max() > 0:
                    has = np.array([used[gain.argmax()] in columns[i] for i in at])
                    open_ += [at[~has], at[has]]
                    continue
            done += at.tolist()
        return done

    def dense(self, used: np.ndarray) -> np.ndarray:
        """Items by the ``used`` terms (sorted places in ``terms``)."""
        out = np.zeros((len(self.columns), len(used)))
        place = np.full(len(self.terms), -1)
        place[used] = np.arange(len(used))
        for i, c in enumerate(self.columns):
            p = place[c]
            p = p[p >= 0]
            out[i, p] = self.weights[used[p]]
        return out


def _above(rows: np.ndarray, size: int) -> np.ndarray:
    """Largest coordinates of each ``size`` rows."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    return np.minimum.reduceat(values, np.arange(0, len(values), size))


class Best:
    """The k best documents so far of every item: higher score, then smaller id, ids before null."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.score = np.ones(items)  # what a document must reach: the k-th score, and 1
        self.null, self.id = np.full(items, 2), np.zeros(items, np.int64)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.waiting = 0

    def offer(self, at: np.ndarray, scores: np.ndarray, null: np.ndarray, ids: np.ndarray):
        """Scores of documents (rows) for the items ``at``."""
        need = self.score[at]
        better = scores > need
        tied = (scores == need) & ((null[:, None] < self.null[at]) | ((null[:, None] == self.null[at]) & (ids[:, None] < self.id[at])))
        d, i = np.nonzero(better | tied)
        if len(d):
            self.held.append((at[i], scores[d, i], null[d], ids[d]))
            self.waiting += len(d)
            if self.waiting > 2 * self.k * max(self.items, 64):
                self.settle()

    def settle(self):
        item, score, null, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, null, -score, item))
        item, score, null, ids = (c[order] for c in (item, score, null, ids))
        start = np.searchsorted(item, np.arange(self.items))
        kept = np.arange(len(item)) - start[item] < self.k
        item, score, null, ids = (c[kept] for c in (item, score, null, ids))
        self.held, self.waiting = [(item, score, null, ids)], 0
        last = np.searchsorted(item, np.arange(self.items), "right") - 1
        full = np.bincount(item, minlength=self.items) == self.k
        self.score[full], self.null[full], self.id[full] = score[last[full]], null[last[full]], ids[last[full]]


def _meet(tree: ItemTree, best: Best, null: np.ndarray, ids: np.ndarray, docs: np.ndarray, used: np.ndarray):
    """One batch of documents (rows of ``docs`` over the ``used`` terms) against all items."""
    items = tree.dense(used)
    leaves = _above(items, ITEM_LEAF)
    nodes = _above(leaves, FAN)
    near = docs @ leaves.T
    order = np.lexsort((-near.max(1), near.argmax(1)))
    docs, null, ids = docs[order], null[order], ids[order]
    doc_leaves = _above(docs, DOC_LEAF)
    doc_nodes = _above(doc_leaves, FAN)
    bounds = doc_nodes @ nodes.T
    for a in np.argsort(-bounds.max(1), kind="stable"):
        need = _least(best.score, ITEM_LEAF)
        open_nodes = np.flatnonzero(bounds[a] >= _least(need, FAN))
        if not len(open_nodes):
            continue
        under = (open_nodes[:, None] * FAN + np.arange(FAN)).ravel()
        under = under[under < len(leaves)]
        below = np.arange(a * FAN, min((a + 1) * FAN, len(doc_leaves)))
        open_leaves = doc_leaves[below] @ leaves[under].T >= need[under]
        for row, b in zip(open_leaves, below):
            if row.any():
                at = (under[row][:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
                at = at[at < len(items)]
                one = slice(b * DOC_LEAF, (b + 1) * DOC_LEAF)
                best.offer(at, docs[one] @ items[at].T, null[one], ids[one])


def _search(lot, documents: int, total: int, k: int):
    def run(batches):
        tree: ItemTree = lot.value
        best = Best(len(tree.numbers), k)
        step = max(DOC_LEAF, CELLS // max(len(tree.terms), 1))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                null = np.array([d is None for d in batch.column("doc_id").to_pylist()], np.int64)
                ids = np.array([d or 0 for d in batch.column("doc_id").to_pylist()], np.int64)
                found = batch.column("terms").to_pylist()
                row = np.repeat(np.arange(len(found)), [len(f) // 8 for f in found])
                h = np.frombuffer(b"".join(found), np.int64)
                tf = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4").astype(np.int64)
                at = np.minimum(np.searchsorted(tree.terms, h), len(tree.terms) - 1)
                same = tree.terms[at] == h
                row, at, tf = row[same], at[same], tf[same]
                if not len(at):
                    continue
                m = 50 + 50 * np.array(batch.column("n").to_pylist(), np.int64) * documents // total
                used, column = np.unique(at, return_inverse=True)
                docs = np.zeros((len(found), len(used)))
                docs[row, column] = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
                _meet(tree, best, null, ids, docs, used)
        best.settle()
        item, score, null, ids = best.held[0]
        yield tree.numbers[item], [None if x else int(i) for x, i in zip(null, ids)], score.astype(np.int64)

    return run


def rank_documents(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    The score is the integer saturated-frequency score of the item's distinct terms; only scores above 0 count, equal ones go by
    ascending doc_id, null ids last. A null text, or one without terms, has no terms: such a document is not counted,
    such an item has no rows. Every row is a document or an item of its own, also one that repeats an id. Other columns
    are ignored; an empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    held = map_arrow(items.select("item_id", "text"), _item_terms, "item_id long, terms array<long>").filter("size(terms) > 0")
    held = cut_lineage(held.withColumn("number", F.monotonically_increasing_id()))
    single = held.select("number", F.explode("terms").alias("term"))
    slots = np.zeros(SLOTS, bool)  # at most SLOTS rows come to the driver
    slots[single.select(F.col("term").bitwiseAND(SLOTS - 1).alias("slot")).distinct().toPandas()["slot"].to_numpy(int)] = True
    vectors = map_arrow(documents.select("doc_id", "text"), _vectors(spark.sparkContext.broadcast(slots)), "doc_id long, n long, terms binary, counts binary")
    vectors = cut_lineage(vectors.filter("n > 0"))
    size = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    lots = max(1, math.ceil((single.count()) / LOT_TERMS))
    dfs = map_arrow(vectors.select("terms"), _frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weighted = cut_lineage(single.join(dfs, "term").withColumn("lot", F.pmod(F.xxhash64("number"), F.lit(lots))))
    found = None
    for lot in range(lots):
        rows = weighted.filter(F.col("lot") == lot).select("number", "term", "df").toPandas()  # a lot: about LOT_TERMS rows
        if not len(rows):
            continue
        weight = {df: math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * df + 1))) for df in rows["df"].unique().tolist()}
        tree = spark.sparkContext.broadcast(ItemTree(rows["number"].to_numpy(), rows["term"].to_numpy(), rows["df"].map(weight).to_numpy(float)))
        part = map_arrow(vectors, _search(tree, size["documents"], size["total"], k), "number long, doc_id long, score long")
        part = cut_lineage(part.withColumn("salt", F.spark_partition_id() % 64))
        tree.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    some = found.withColumn("rank", rank("number", "salt")).filter(F.col("rank") <= k).drop("rank")
    top = some.withColumn("rank", rank("number")).filter(F.col("rank") <= k)
    return top.join(held.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same rows in SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS number, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}') AS ts FROM benchmark),
size AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, size GROUP BY term),
q AS (SELECT DISTINCT number, item_id, term FROM (SELECT number, item_id, unnest(ts) AS term FROM i)),
s AS (SELECT number, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), size GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {K}
"""
