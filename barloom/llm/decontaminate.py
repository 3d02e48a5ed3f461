"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. A local alignment of words (``MATCH``, ``MISS``, ``GAP``) scores a
passage of a document by the share of the score of a full copy. An item is found in a document by either of two rules:

* the whole item: a passage scores the share ``least`` or more;
* a part of it: an alignment in which every matched word gives 1 and every error takes ``STRICT`` reaches ``PASSAGE``,
  that is, that many words in one piece, or ``STRICT`` more for each error between them, whatever the item's length.

Seeds only spare alignments that can meet neither rule. An alignment with m matched words and e errors scores 2m - e and has at most e + 1 runs of matched words, so one
that reaches the share ``least`` of an item of n words matches at least (2 least - 1) n - 1 pairs of successive words of
the item; where that says nothing (short items) it matches at least least * n words. By the second rule it matches
``PASSAGE`` - 1 pairs. The smaller number counts. These pairs or words are the item's grams. The
commonest ones, as many as half of the number needed, are left out; the rest are seeds, and a passage is aligned when it
holds the other half of the number within the longest stretch that such an alignment can span. So nothing is lost
against aligning every item with every document. Rarity is the number of documents, counted over all of them.

Items are taken in blocks of ``ITEMS``, which bounds what is sent to the tasks; all documents are read for each block.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_arrow, small_side
from barloom.session import cut_lineage

GRAM = 3
MATCH, MISS, GAP = 2, -1, -1
LEAST = 0.6
PASSAGE, STRICT = 13, 4
#: (PASSAGE + STRICT e) words in at most e + 1 runs: one run has as many at least.
RUN = STRICT + 1
ITEMS = 20_000
_WORDS = re.compile(r"[^\W_]+")
FOUND = "doc_id long, text_key long, item_id long, score double, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Items:
    """A block of test items as word codes, and their grams (pairs of words, or words) as sorted keys."""

    def __init__(self, rows, least: float = LEAST):
        self.codes, self.items, self.ids = {}, [], []
        for item_id, text in rows:
            found = words_of(text)
            if len(found) >= GRAM:
                self.ids.append(item_id)
                self.items.append(np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in found], np.int64))
        sizes = [len(x) for x in self.items]
        # what an alignment that meets a rule needs: matched pairs of words, or else matched words
        pairs = [math.ceil((2 * least - 1) * n - 1 - 1e-9) for n in sizes]
        self.paired = [b > 0 for b in pairs]
        self.need = [b if b > 0 else max(1, math.ceil(least * n - 1e-9)) for b, n in zip(pairs, sizes)]
        self.need = [min(b, PASSAGE - two) if n >= PASSAGE else b for b, two, n in zip(self.need, self.paired, sizes)]
        #: most errors of such an alignment
        self.errors = [max(math.floor(2 * n * (1 - least) + 1e-9), (n - PASSAGE) // STRICT) for n in sizes]
        keys = [self.pair_keys(x) if two else x for x, two in zip(self.items, self.paired)]
        self.grams = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.of_item = [np.searchsorted(self.grams, k) for k in keys]

    @staticmethod
    def pair_keys(codes: np.ndarray) -> np.ndarray:
        """Above all codes, and apart for different pairs."""
        return (codes[:-1] << 31) + codes[1:]

    def encode(self, text: str | None) -> np.ndarray:
        """Item codes of a text's words, 0 for words of no item."""
        found = words_of(text)
        get = self.codes.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the item grams among the codes."""
        known = np.flatnonzero(codes)
        if not len(known) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        two = known[:-1][np.diff(known) == 1]
        at, keys = two, (codes[two] << 31) + codes[two + 1]
        if not all(self.paired):
            at, keys = np.concatenate([at, known]), np.concatenate([keys, codes[known]])
        gram = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        good = self.grams[gram] == keys
        return at[good], gram[good]

    def choose(self, counts: np.ndarray) -> None:
        """Seeds of each item: all its grams but the commonest; ``seen`` is how many a passage must hold."""
        gram, item, place = [], [], []
        self.seen = np.array([n - n // 2 for n in self.need], np.int64)
        for k, grams in enumerate(self.of_item):
            rarest = np.lexsort((self.grams[grams], counts[grams]))[: len(grams) - self.need[k] // 2]
            gram.append(grams[rarest])
            item.append(np.full(len(rarest), k, np.int64))
            place.append(rarest)
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
        order = np.argsort(gram, kind="stable")
        self.seed_item, self.seed_place = item[order], place[order]
        self.first_seed = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))
        self.longest = np.array([len(x) + e for x, e in zip(self.items, self.errors)], np.int64)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, and the first and last place of each stretch with enough places of an item's seeds."""
        at, grams = self.hits(codes)
        n = self.first_seed[grams + 1] - self.first_seed[grams]
        if not n.sum():
            return at[:0], at[:0], at[:0]
        seed = np.repeat(self.first_seed[grams] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.unique(self.seed_item[seed] * len(codes) + np.repeat(at, n))  # a place counts once
        item, place = np.divmod(key, len(codes))
        last = np.arange(len(key)) + self.seen[item] - 1
        ends = np.minimum(last, len(key) - 1)
        good = (last < len(key)) & (item[ends] == item) & (place[ends] - place <= self.longest[item])
        return item[good], place[good], place[ends[good]]


def shares_run(item: np.ndarray, passage: np.ndarray) -> bool:
    """Whether ``RUN`` successive words of the item seem to be in the passage (never a false no)."""
    if min(len(item), len(passage)) < RUN:
        return False
    mix = np.array([0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x1B873593CC9E2D51, 0x27D4EB2F165667C5, 0x165667B19E3779F9], np.int64)
    own, there = (np.lib.stride_tricks.sliding_window_view(x, RUN) @ mix[:RUN] for x in (item, passage))
    return bool(np.isin(own, there).any())


def align(item: np.ndarray, passage: np.ndarray, match: int = MATCH, miss: int = MISS, gap: int = GAP) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment; places are of the passage, last inclusive."""
    width = len(passage)
    steps = np.arange(width) * -gap
    above, came = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best = (0, 0, -1)
    for code in item:
        same = np.where(passage == code, match, miss)
        diagonal, upper = above[:-1] + same, above[1:] + gap
        now = np.maximum(np.maximum(diagonal, upper), 0)
        start = np.where(now == 0, np.arange(1, width + 1), np.where(now == diagonal, came[:-1], came[1:]))
        # a run of gaps along the passage: the best earlier cell less its distance
        lifted = now + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(width), 0))
        now, start = top - steps, start[source]
        above, came = np.concatenate([[0], now]), np.concatenate([[0], start])
        k = int(now.argmax())
        if now[k] > best[0]:
            best = (int(now[k]), int(start[k]), k)
    return best


def find_leaks(items: Items, codes: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(item number, score, first word, last word): the best passage of each item by the two rules."""
    found: dict[int, list[list[int]]] = {}
    for k, first, last in zip(*(x.tolist() for x in items.candidates(codes))):
        # an alignment that holds these seeds lies within its longest stretch of each of them
        reach, spans = int(items.longest[k]), found.setdefault(k, [])
        lo, hi = max(0, last - reach), min(len(codes), first + reach + 1)
        if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 8 * len(items.items[k]):
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    out = []
    for k, spans in found.items():
        item = items.items[k]
        size, best = len(item), (0.0, 0, 0)
        for lo, hi in spans:
            passage = codes[lo:hi]
            if np.isin(item, passage).sum() >= least * size - 1e-9:  # every point comes from a word that is there
                score, first, last = align(item, passage)
                if score / (MATCH * size) >= least:
                    best = max(best, (score / (MATCH * size), -(lo + first), lo + last))
                    continue
            if size >= PASSAGE and shares_run(item, passage):
                points, first, last = align(item, passage, 1, -STRICT, -STRICT)
                if points >= PASSAGE:
                    score = align(item, passage[first : last + 1])[0]
                    best = max(best, (score / (MATCH * size), -(lo + first), lo + last))
        if best[0] > 0:
            out.append((k, best[0], -best[1], best[2]))
    return out


def _count(block):
    def run(batches):
        items = block.value
        total = np.zeros(len(items.grams), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                grams = np.unique(items.hits(items.encode(text))[1])
                total[grams] += 1
        seen = np.flatnonzero(total)
        yield seen, total[seen]

    return run


def _search(block, least: float):
    def run(batches):
        items = block.value
        for batch in batches:
            rows = []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                rows += [(doc, key, items.ids[k], score, first, last) for k, score, first, last in find_leaks(items, items.encode(text), least)]
            yield tuple(list(c) for c in zip(*rows)) if rows else ((),) * 6

    return run


def find_contamination(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, text_key, item_id, score, first_word, last_word): each test item found in each document.

    score is 1 for a full copy and falls with each edit; only the best passage of an item in a document is given. It is
    below ``least`` where only a part of the item is found (second rule). Null and empty texts hold nothing, items with fewer than ``GRAM`` words are not looked for;
    repeated rows are searched alike; a null doc_id or item_id is kept; other columns are ignored; without documents or
    items the result is empty. text_key is a hash of the text, to find the row again.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    parts, rows = [], []

    def search():
        items = Items(rows, least)
        counted = map_arrow(texts.select("text"), _count(spark.sparkContext.broadcast(items)), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(items.grams), np.int64)
        for r in counted.collect():  # at most the n-grams of one block of items
            counts[r["gram"]] = r["n"]
        items.choose(counts)
        parts.append(cut_lineage(map_arrow(texts, _search(spark.sparkContext.broadcast(items), least), FOUND)))
        rows.clear()

    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) >= ITEMS:
            search()
    if rows:
        search()
    # no empty table of the driver's is joined in: its rows may pass through Python workers beside those of the search
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], FOUND)


def without_contamination(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``documents`` without those that hold a passage of a test item."""
    found = small_side(find_contamination(documents, benchmark, least).select("doc_id", "text_key").distinct())
    same = documents["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(documents["text"]) == found["text_key"])
    return documents.join(found, same, "left_anti")
