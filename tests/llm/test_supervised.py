"""Language, toxicity and quality: held-out accuracy, and defined results for odd rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import language, quality, toxicity
from barloom.llm.common import fold
from barloom.llm.supervised import below, score_documents

SF = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def odd(spark):
    rows = [(None, None, "de"), (1, "", None), (2, "*** 123 ---", "xx"), (3, "the and of " * 60_000, "en"), (3, "the and of", "en"), (3, "the and of", "en"), (None, "\ud7ff é", None)]
    return spark.createDataFrame([(*r, 0.5, "p") for r in rows], "doc_id long, text string, lang string, score double, predicted string")


def test_held_out_languages(spark, tables):
    docs = tables[0]
    model = language.fit(docs, PIECES)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    got = language.identify(odd(spark), model).collect()
    assert len(got) == 7 and [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0] * 3
    assert got[3].lang_pred == "en" and got[4] == got[5] and got[0].held_out is None and 0 <= got[6].score <= 1


def test_languages_ignore_the_held_out_fold(spark, tables):
    docs = tables[0]
    spoiled = docs.withColumn("lang", F.when(fold(F.col("doc_id"), 4) == 2, "zz").otherwise(F.col("lang")))
    assert language.fit(spoiled, PIECES, per_language=20).languages == ["de", "en", "es", "fr"]


def test_language_sums_all_segmentations():
    model = language.Model(["a"], None, PIECES)
    pieces = model.pieces()
    import numpy as np

    chance = np.random.default_rng(1).random(pieces.size)
    model.chances = np.append(chance, 0.0)[:, None]

    def total(raw):
        ids = lambda p: pieces.find(np.array([pieces.hash_of(p)], np.uint64))[0]
        sums = [1.0]
        for j in range(1, len(raw) + 1):
            sums.append(sum(sums[i] * chance[ids(raw[i:j])] for i in range(max(0, j - language.PIECE), j) if ids(raw[i:j]) >= 0))
        return sums[-1]

    words = ["the", "überall", "x", "thing", "naïve"]
    got = np.exp(model.word_scores(words)[:, 0])
    assert np.allclose(got, [total(b" " + w.encode()) for w in words])


def test_long_pieces_long_words_and_marks():
    import numpy as np

    model = language.Model(["a", "b"], None, PIECES)
    pieces = model.pieces()
    assert pieces.longest == 33 and pieces.size == 50_256
    rng = np.random.default_rng(3)
    model.chances = np.append(rng.random((pieces.size, 2)) ** 8 / 1000, np.zeros((1, 2)), 0)

    def log_total(raw, column):
        ids = lambda p: pieces.find(np.array([pieces.hash_of(p)], np.uint64))[0]
        logs = [0.0]
        for j in range(1, len(raw) + 1):
            found = [(i, ids(raw[i:j])) for i in range(max(0, j - 40), j)]
            logs.append(np.logaddexp.reduce([logs[i] + np.log(model.chances[k, column]) for i, k in found if k >= 0]))
        return logs[-1]

    words = ["действительно", "ありがとうございます", "nationalism's", "ẃord,", "你好" * 60, "unbroken" * 40]
    got = model.word_scores(words)
    assert np.allclose(got, [[log_total(b" " + w.encode(), c) for c in (0, 1)] for w in words])
    # every byte between blanks counts
    assert model.predict(["ab, cd!"])[1] == model.predict(["cd!  ab,"])[1] != model.predict(["ab cd"])[1]
    # expected counts of one round, by listing all segmentations
    word, size = "natio", pieces.size

    def ways(raw):
        if not raw:
            yield []
        for k in range(1, len(raw) + 1):
            i = pieces.find(np.array([pieces.hash_of(raw[:k])], np.uint64))[0]
            if i >= 0:
                yield from ([i, *rest] for rest in ways(raw[k:]))

    want, total = np.zeros(size), 0.0
    for way in ways(b" " + word.encode()):
        total += size ** -float(len(way))
        np.add.at(want, way, size ** -float(len(way)))
    want = want / total * 7 + language.SMOOTH
    assert np.allclose(language._learn(pieces, size, [word], np.array([7.0]), 1), want / want.sum(), rtol=1e-9)


def test_no_languages(spark, tables):
    none = tables[0].limit(0)
    model = language.fit(none, PIECES)
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(tables[0].limit(5), model).collect()} == {"und"}


@pytest.mark.parametrize("module, label, limit", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_labels(spark, tables, module, label, limit):
    docs, labels = tables
    model = module.fit(docs, labels)
    rows = score_documents(docs, model, limit).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r[label] for r in rows) / len(rows)
    assert len(rows) > 50 and right > 0.95
    got = score_documents(odd(spark), model, limit).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and got[0].held_out is None and got[0].score == got[1].score
    assert got[4] == got[5] and below(odd(spark), model, 2.0).columns == odd(spark).columns


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_nothing_to_learn_from(spark, tables, module, label):
    docs, labels = tables
    odd_labels = spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 0, 0), (5, 1, 1), (6, 7, 7)], "doc_id long, quality int, toxic int")
    for some in (labels.limit(0), odd_labels):
        rows = score_documents(docs.limit(3), module.fit(docs, some)).collect()
        assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert score_documents(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_held_out_labels_are_not_learnt(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.weight == b.weight).all() and a.intercept == b.intercept
