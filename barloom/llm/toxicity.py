"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams it holds at all (presence, not counts). Each is scaled by
the log of how much more often toxic than other training documents hold it; logistic regression with an L2
penalty on the scaled features gives the weights. Training uses a bounded sample of labelled documents, about
``PER_CLASS`` of each label chosen by a hash of the id; whole texts are read in training and scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import map_arrow
from barloom.llm.supervised import FOLDS, labelled_sample
from barloom.session import cut_lineage

BITS = 18
SIZES = (3, 4, 5)
PER_CLASS = 1500
SEEN, TELLING = 3, 2.0
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def features(text: str | None, mark: np.ndarray | None = None) -> np.ndarray:
    """Ids of all n-grams of the text with A-Z lower-cased, blanks folded and padded, each once; any order."""
    raw = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    raw[raw <= 32] = 32
    found = []
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h += raw[k : k + m]
            h *= _ODD[k]
            h ^= h >> np.uint32(15)
        found.append(h >> np.uint32(32 - BITS))
    ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
    if mark is None:
        return np.unique(ids)
    mark[ids] = True
    ids = np.flatnonzero(mark)
    mark[ids] = False
    return ids


@dataclass
class Model:
    """Weight per feature (already times its ratio) and the intercept; without training, every score is 0."""

    weight: np.ndarray
    intercept: float

    def score(self, texts) -> np.ndarray:
        mark = np.zeros(1 << BITS, bool)
        z = np.array([self.weight[features(t, mark)].sum() + self.intercept for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _document_counts(batches):
    """Per task, how many toxic and other documents hold each feature."""
    mark, counts = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            counts[y, features(t, mark)] += 1
    seen = np.flatnonzero(counts.any(0))
    yield seen, counts[1, seen], counts[0, seen]


def _kept(place):
    def run(batches):
        mark = np.zeros(1 << BITS, bool)
        for batch in batches:
            ids = [place.value[features(t, mark)] for t in batch.column("text").to_pylist()]
            yield batch.column("y"), [np.sort(i[i >= 0]).astype("<i4").tobytes() for i in ids]

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, rounds: int = 60, seen: int = SEEN, telling: float = TELLING) -> Model:
    """Train on the sample; with only one label known, or none, the model gives 0 for all.

    Documents holding each feature are counted on the executors first. Features that fewer than ``seen`` sampled documents
    hold, or that are less than ``telling`` times likelier under one label, weigh nothing and are not sent to the driver.
    """
    spark = documents.sparkSession
    sample = cut_lineage(labelled_sample(documents, labels, label, FOLDS, 0, per_class))
    of_label = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    size = 1 << BITS
    if len(of_label) < 2:
        return Model(np.zeros(size), -30.0)
    counts = map_arrow(sample, _document_counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    pos, neg = np.zeros(size), np.zeros(size)
    pos[counts["feature"]], neg[counts["feature"]] = counts["pos"], counts["neg"]
    ratio = np.log((pos + 1) / (of_label[1] + 2)) - np.log((neg + 1) / (of_label[0] + 2))
    keep = np.flatnonzero((pos + neg >= seen) & (np.abs(ratio) > np.log(telling)))
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))
    sent = spark.sparkContext.broadcast(place)
    rows = sorted(map_arrow(sample, _kept(sent), "y int, ids binary").collect(), key=lambda r: (r["y"], r["ids"]))
    sent.destroy()
    y = np.array([r["y"] for r in rows], float)
    parts = [np.frombuffer(r["ids"], "<i4") for r in rows]
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    at = np.concatenate(parts)
    del rows, parts
    scaled = ratio[keep]
    w, b, vw, vb = np.zeros(len(keep)), 0.0, np.zeros(len(keep)), 0.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    step = 8.0 / (np.bincount(doc, scaled[at] ** 2, len(y)).mean() + 1)
    for _ in range(rounds):
        wl, bl = w + 0.9 * vw, b + 0.9 * vb
        z = np.bincount(doc, (wl * scaled)[at], len(y)) + bl
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        gw = np.bincount(at, e[doc], len(keep)) * scaled + 1e-4 * wl
        vw, vb = 0.9 * vw - step * gw, 0.9 * vb - step * e.sum()
        w, b = w + vw, b + vb
    weight = np.zeros(size)
    weight[keep] = w * scaled
    return Model(weight, float(b))
