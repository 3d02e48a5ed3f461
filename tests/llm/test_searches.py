"""Both searches against scores of every pair."""

import math
import random
import re

import numpy as np
import pytest

from barloom.llm import block_search, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    split = [terms(t) for _, t in docs]
    n, total = sum(map(bool, split)), sum(map(len, split))
    df = {}
    for ts in split:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for (doc, _), ts in zip(docs, split):
            if not ts:
                continue
            m = 50 + (50 * len(ts) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * ts.count(t)) // (1000 * ts.count(t) + 20 * m)) for t in set(terms(text)) & set(ts))
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") * rng.randint(1, 3) + rng.choice("cdéñ漢") * rng.randint(0, 3)
    rows = [(rng.randrange(10_000), rng.choice([" ", "-", "\n", "_"]).join(word() for _ in range(rng.choice([1, 5, 30, 120])))) for _ in range(size)]
    copies = [(20_000 + k, rows[0][1]) for k in range(40)]
    items = [(k, rows[k % 9][1][:60] if k % 3 else " ".join(word() for _ in range(8))) for k in range(30)]
    return rows + copies + [(None, rows[1][1]), rows[2], rows[2], (3, None), (4, ""), (5, "-- !"), (6, "ABC abc AbC x"), (7, "  ")], items + [(50, None), (51, "..."), (3, items[3][1]), (None, "abc x"), (52, "unseen")]


@pytest.mark.parametrize("seed, k", [(1, 50), (2, 3), (3, 7)])
def test_every_score(spark, seed, k, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 600)
    docs, items = corpus(seed, 150)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, number int")
    got = lexical.rank_documents(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, k)


def test_lots_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "LOT_TERMS", 40)
    monkeypatch.setattr(lexical, "PIECE", 50)
    docs, items = corpus(9, 60)
    docs.append((77, "ab " * 4000 + "ac"))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.rank_documents(d, q, 5).collect()), key=repr) == ranked(docs, items, 5)


def test_empty_sides(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(d.limit(0), q).count() == 0 and lexical.rank_documents(d, q.limit(0)).count() == 0
    assert lexical.rank_documents(d, q.selectExpr("item_id", "cast(null as string) text")).count() == 0


def test_wanted_terms_are_forgotten_by_size():
    slots = np.ones(lexical.SLOTS, bool)
    kept = lexical.Wanted(slots)
    kept.bytes = lexical.MEMORY
    assert kept[b"abc"] == lexical.term_hash(b"abc") and len(kept) == 1


def nearest(rows, every, k):
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(1.7e308, x)) for x in v]
    vs = [(i, whole(v)) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(vs):
        if i is None or i % every or q is None:
            continue
        found = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), j is None, j or 0) for b, (j, v) in enumerate(vs) if b != a and v is not None and len(v) == len(q)]
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, rows_a_block", [(1, 128), (2, 3), (3, 7)])
def test_every_product(spark, seed, rows_a_block, monkeypatch):
    monkeypatch.setattr(block_search, "ROWS", rows_a_block)
    monkeypatch.setattr(block_search, "BLOCK_PAGE", 8)
    monkeypatch.setattr(block_search, "QUERY_PAGE", 4)
    monkeypatch.setattr(block_search, "PACKET", 3)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    rows = [(int(k), (centres[k % 12] + 0.3 * rng.standard_normal(16)).tolist()) for k in range(240)]
    rows += [(1000 + k, rows[5][1]) for k in range(60)] + [(None, rows[0][1]), rows[50], rows[50], (300, None), (350, [1.0] * 15 + [None]), (400, [math.nan] * 16), (450, [math.inf] * 16)]
    rows += [(500, []), (501, []), (550, [0.0] * 16), (600, [1.0, 2.0]), (650, [-3.0, 1.0]), (700, [1e8] * 4), (701, [1e8, -1e8, 3.0, 1e-3]), (750, [1e15, -2.5, 1.0]), (751, [-1e15, 1e14, 7.0]), (800, [1e307, 1.0, -1e306, 2.0, 5.0]), (801, [5.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, number int, block string").repartition(3)
    got = block_search.nearest_vectors(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == nearest(rows, 50, 5)


def test_no_vectors(spark):
    assert block_search.nearest_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert block_search.nearest_vectors(one).count() == 0


def test_most_blocks_are_passed_over(spark):
    """Bounds of blocks of like vectors leave out most pairs of a query and a block."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((20, 32)), 64, axis=0) + 0.05 * rng.standard_normal((1280, 32))
    x = np.floor(256 * x)
    blocks = x.reshape(20, 64, 32)
    q = x[::64]
    bound = np.maximum(q, 0) @ blocks.max(1).T + np.minimum(q, 0) @ blocks.min(1).T
    kth = np.sort(q @ x.T, axis=1)[:, -5]
    assert (bound >= (q @ x.T).reshape(20, 20, 64).max(2)).all() and (bound >= kth[:, None]).mean() < 0.3
