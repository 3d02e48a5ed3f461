"""The n-gram join, the vector links and the components against brute force."""

import math
import os
import random
import re

import numpy as np
import pytest

from barloom.llm import common, ngram_join, vector_dups


def united(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(500, k) for k in range(501, 540)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == united({x for link in real for x in link}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = united(range(len(rows)), links)
    low = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root[k]] = min(doc, low.get(root[k], doc))
    return sorted(((doc, len(sets[k]), low.get(root[k], doc) if sets[k] else doc) for k, (doc, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common_passage = [word() for _ in range(20)]
    for base in range(12):
        body = [word() for _ in range(rng.choice([5, 8, 30, 90, 200]))]
        if base % 3 == 0:
            body = common_passage + body
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(body)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.randrange(10_000), " ".join(copy)))
    return rows + [(None, None), (3, ""), (4, " \n"), (5, "One two"), (6, "one TWO"), (7, "É é"), (None, rows[0][1]), rows[1], rows[1], (8, "\u00a0x\u00a0y z w")]


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 4, 85)])
def test_ngram_join_against_all_pairs(spark, seed, words, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, text_key string").repartition(5)
    got = ngram_join.component_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, words, percent)


def test_one_of_each_group_stays(spark):
    body = " ".join(f"w{k}" for k in range(100))
    rows = [(5, body), (2, body + " tail"), (9, "w1 w2"), (9, "w1 w2"), (4, None), (6, ""), (None, body)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, body + " tail"), (4, None), (6, ""), (9, "w1 w2")] or sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 9]
    assert ngram_join.one_of_each(docs.limit(0), 5, 80).count() == 0


def test_one_very_long_text(spark):
    body = " ".join(f"w{k % 30_011}" for k in range(120_000))
    docs = spark.createDataFrame([(1, body), (2, body + " end"), (3, body[: len(body) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.component_rows(docs).collect()}[2] == 1


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(30):
        base = rng.standard_normal(16)
        for k in range(int(rng.integers(1, 12))):
            rows.append((base + rng.standard_normal(16) * 0.15 * (k > 1)).tolist())
    return rows + [[0.0] * 16, None, [1.0] * 15 + [None], [math.nan] * 16, [math.inf] + [1.0] * 15, [], [1e300] * 16, [1e300] * 16, [1e-300] * 16, [1.0] * 4]


def test_vector_links_against_all_pairs(spark):
    rows = [(7 * k % 1009, v) for k, v in enumerate(vectors(3))]
    rows += [(None, rows[0][1]), rows[2]]
    units = []
    for _, v in rows:
        x = None if v is None or None in v or not len(v) or not np.isfinite(v).all() or not np.any(v) else np.array(v) / np.abs(v).max()
        units.append(None if x is None else x / np.sqrt(x @ x))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    root, degree, low = united(range(len(rows)), links), [0] * len(rows), {}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for k, (v, _) in enumerate(rows):
        if v is not None:
            low[root[k]] = min(v, low.get(root[k], v))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    got = sorted((tuple(r) for r in vector_dups.link_vectors(df, recall=0.999999).collect()), key=repr)
    assert got == sorted(((v, degree[k], low.get(root[k], v), v == low.get(root[k], v)) for k, (v, _) in enumerate(rows)), key=repr)
    assert vector_dups.link_vectors(df.limit(0)).count() == 0


def test_crowded_buckets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(k, (np.ones(8) + 0.05 * rng.standard_normal(8)).tolist()) for k in range(40)]
    got = vector_dups.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.9999).collect()
    assert all(r.n_links == 39 and r.component_id == 0 for r in got)


def test_recall_of_the_index(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.stack([np.array(r.embedding, float) for r in df.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T) >= 0.9).sum(1) - 1
    got = np.array([r.n_links for r in vector_dups.link_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_one_of_each_leaves_the_rows_found_only(spark):
    from barloom.session import recorded_tables

    docs = spark.createDataFrame([(k, f"a b c d e f g {k % 3}") for k in range(9)], "doc_id long, text string")
    with recorded_tables() as written:
        kept = ngram_join.one_of_each(docs, 5, 80)
    here = [p for p in written if os.path.exists(p.removeprefix("file:"))]
    assert len(written) > 5 and here == written[-3:]  # the rows and two lists taken from them
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
