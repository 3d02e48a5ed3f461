"""Source mixes and benchmark leaks."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import decontaminate, mixing


def water(words, weights):
    """Targets by bisection of the common level."""
    lo, hi = 0.0, 4.0 * sum(words) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(3 * w, mid * k) for w, k in zip(words, weights)) < sum(words):
            lo = mid
        else:
            hi = mid
    return [min(3 * w, hi * k) for w, k in zip(words, weights)]


def test_targets():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 9)
        words, weights = [rng.choice([0, 1, 10, 5000]) * rng.randrange(1, 9) for _ in range(n)], [1 + k % 3 for k in range(n)]
        got = mixing.targets(words, weights)
        assert sum(got) == sum(words) and np.allclose([float(x) for x in got], water(words, weights), atol=1e-6 * (1 + sum(words)))
    assert mixing.targets([], []) == []


def documents(spark):
    rng, rows = random.Random(4), []
    for k in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", None, "\U0001f600", "\uffff"])
        rows.append((k, "w " * rng.choice([0, 1, 5, 40, 400]), source, "x", 1))
    rows += [(None, "w w", "a", "x", 1), (5, "w", "b", "x", 1), (5, "w", "b", "x", 1), (1000, None, "d", "x", 1), (1001, "z " * 20_000, "e", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, idx string, block int")


def test_mix_meets_targets(spark):
    docs = documents(spark)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    per = {}
    for r in rows:
        per[r.target, r.source_size] = per.get((r.target, r.source_size), 0) + r.taken
    for (target, size), taken in per.items():  # to within a few words, or half of a source's only document
        assert abs(taken - target) <= (20 + 0.01 * target if size != 20_000 else 10_000), (size, target, taken)
    sizes = [r["n"] for r in docs.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("w|z")), F.lit(0))).alias("n")).orderBy(F.asc_nulls_last("source")).collect()]
    want = water(sizes, [1 + k % 3 for k in range(len(sizes))])
    assert np.allclose(sorted({r.target for r in rows}), sorted(set(want)), atol=1e-3)


def test_mixed_rows_are_the_copies_taken(spark):
    docs = documents(spark)
    mixed, rows = mixing.mix_documents(docs), mixing.mix_report(docs).collect()
    assert mixed.columns == docs.columns and mixed.count() == sum(len(r.shards) for r in rows)
    assert mixing.mix_documents(docs.limit(0)).count() == mixing.mix_report(docs.limit(0)).count() == 0


def test_tree_gives_exact_disjoint_quotas():
    quota = np.array([700, 31, 0, 250])
    tree = mixing.SplitTree(quota, 13, 9)
    source = np.repeat(np.arange(4), quota)
    slot = np.concatenate([np.arange(n) for n in quota])
    shard = tree.place(source, slot)
    sizes = np.bincount(shard, minlength=13)
    assert sizes.sum() == quota.sum() and sizes.max() - sizes.min() <= 1
    order = np.random.default_rng(1).permutation(len(slot))
    assert (tree.place(source[order], slot[order]) == shard[order]).all()
    for s in range(4):  # a source's blocks, in order, fill its quotas in turn
        assert (np.diff(shard[source == s]) >= 0).all()


def plain_alignment(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = decontaminate.MATCH if item[i - 1] == passage[j - 1] else decontaminate.MISS
            h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_table():
    rng = np.random.default_rng(8)
    for _ in range(200):
        item, passage = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        score, first, last = decontaminate.align(item, passage)
        assert score == plain_alignment(item, passage)
        if score:
            assert plain_alignment(item, passage[first : last + 1]) == score


def leak_tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(5)]
    filler = lambda n: [word() for _ in range(n)]
    edited = list(items[1])
    for k in (5, 14, 23):
        edited[k] = word()
    shuffled = items[2][:15] + ["extra", "words"] + items[2][16:]
    texts = [
        filler(40) + [w.upper() + "," for w in items[0]] + filler(9), edited + filler(300), filler(200) + shuffled, filler(500),
        filler(20) + items[3][:6] + filler(20), filler(30_000) + items[4] + filler(10), [], items[0] + filler(3) + items[0] + items[4],
    ]
    rows = [(k, " ".join(t), k, "x") for k, t in enumerate(texts)] + [(8, None, 0, "x"), (None, " ".join(items[1]), 0, "x"), (0, " ".join(texts[0]), 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, score string")
    tests = spark.createDataFrame([(k, " ".join(i), "y") for k, i in enumerate(items)] + [(50, None, "y"), (51, "", "y"), (52, "two words", "y"), (None, " ".join(items[3]), "y")], "item_id long, text string, doc_id string")
    return docs, tests


def test_leaks_are_found_and_clean_documents_left(spark, monkeypatch):
    docs, tests = leak_tables(spark)
    want = sorted([(0, 0), (0, 0), (1, 1), (2, 2), (5, 4), (7, 0), (7, 4), (None, 1)], key=repr)
    for items in (20_000, 2):
        monkeypatch.setattr(decontaminate, "ITEMS", items)
        rows = decontaminate.find_contamination(docs, tests).collect()
        assert sorted(((r.doc_id, r.item_id) for r in rows), key=repr) == want
    score = {(r.doc_id, r.item_id): r.score for r in rows}
    assert score[0, 0] == score[5, 4] == 1 and 0.8 < score[1, 1] < 1 and 0.8 < score[2, 2] < 1
    kept = decontaminate.without_contamination(docs, tests)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 8]


def edited_copies(rng, word, items):
    """Copies with every fifth or sixth word replaced, with words replaced, dropped and put in at random, and pristine ones."""
    texts = []
    for item in items:
        texts += [list(item)] + [[word() if k % n == n - 1 else w for k, w in enumerate(item)] for n in (3, 4, 5, 6)]
        texts.append([x for w in item for x in (w, word())][: 2 * len(item)])
        texts.append([x for k, w in enumerate(item) for x in ((w, word()) if k % 2 else (w,))])
        for rate in (0.15, 0.2, 0.3):
            copy = []
            for w in item:
                edit = rng.random() / rate
                copy += [w] if edit >= 1 else [word()] if edit < 0.6 else [] if edit < 0.8 else [w, word()]
            texts.append(copy)
    return texts


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 4, 4, 4])))
    items = [[word() for _ in range(n)] for n in (3, 4, 5, 6, 7, 8, 10, 11, 16, 30, 59)]
    texts = [[word() for _ in range(20)] + t + [word() for _ in range(15)] for t in edited_copies(rng, word, items)]
    texts += [list(t) for t in texts[:3]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    codes = {w: k for k, w in enumerate({w for t in texts + items for w in t})}
    want = {}
    for k, t in enumerate(texts):
        for j, item in enumerate(items):
            score = plain_alignment([codes[w] for w in item], [codes[w] for w in t]) / (2 * len(item))
            if score >= decontaminate.LEAST:
                want[k, j] = score
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_contamination(docs, tests).collect()}
    assert len(want) > 60 and {p: s for p, s in got.items() if s >= decontaminate.LEAST} == want


def plain_part(item, passage):
    """Best local sum of 1 a matched word and -4 an error."""
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if item[i - 1] == passage[j - 1] else -4), h[i - 1][j] - 4, h[i][j - 1] - 4)
            best = max(best, h[i][j])
    return best


def test_partial_passages_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 5, 5, 5])))
    items = [[word() for _ in range(n)] for n in (12, 13, 16, 30, 59, 200, 200)]
    texts = []
    for item in items:
        for n in (12, 13, 14, 17, 21, 25, 30, 35, 100):
            part = item[(at := rng.randrange(max(1, len(item) - n))) : at + n]
            once, twice = list(part), list(part)
            once[len(part) // 2] = word()
            twice[len(part) // 3 : len(part) // 3 + 1] = []
            twice.insert(2 * len(part) // 3, word())
            texts += [[word() for _ in range(25)] + p + [word() for _ in range(30)] for p in (part, once, twice)]
        texts.append([w if rng.random() < 0.65 else word() for w in item])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    whole, part = set(), set()
    for k, t in enumerate(texts):
        for j, item in enumerate(items):
            if set(t) & {w for w in item if len(w) > 1}:
                if plain_alignment(item, t) >= decontaminate.LEAST * 2 * len(item):
                    whole.add((k, j))
                elif plain_part(item, t) >= 13:
                    part.add((k, j))
    rows = decontaminate.find_contamination(docs, tests).collect()
    assert len(part) > 40 and {(r.doc_id, r.item_id) for r in rows} == whole | part
    assert all((r.score >= decontaminate.LEAST) == ((r.doc_id, r.item_id) in whole) for r in rows)
    # 35 of 59 words, word 25 to 59 of the text
    [row] = [r for r in rows if r.doc_id == 4 * 28 + 7 * 3]
    assert (row.item_id, row.first_word, row.last_word) == (4, 25, 59) and abs(row.score - 70 / 118) < 1e-9
    kept = decontaminate.without_contamination(docs, tests)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in whole | part}


def test_empty_sides(spark):
    docs, tests = leak_tables(spark)
    assert decontaminate.find_contamination(docs.limit(0), tests).count() == 0
    assert decontaminate.find_contamination(docs, tests.limit(0)).count() == 0
