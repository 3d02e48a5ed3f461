"""Quality: learned vectors of hashed words and character n-grams, averaged per document, with a softmax on top.

Words keep their case and punctuation, since shouting and markup are what bad text shows. The vector of a
document is the mean over all its words and all character n-grams of the text; vectors and output weights are
learned together by stochastic gradient descent, one document a step. Training uses a bounded sample, about
``PER_CLASS`` documents of each label chosen by a hash of the id; whole texts are read in training and scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from barloom.llm.common import map_arrow
from barloom.llm.supervised import FOLDS, labelled_sample

BITS = 16
SIZES = (3, 4)
DIM = 8
PER_CLASS = 1200
EPOCHS = 6
RATE = 0.2
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_STEP = 0x100000001B3
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(12, n - 1).bit_length() if n > 1 else 2
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(max(size, n), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def tokens(text: str | None) -> np.ndarray:
    """Ids of every word and character n-gram of the text, repeats included."""
    raw = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    raw[raw <= 32] = 32
    found = []
    for n in SIZES:
        m = len(raw) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h += raw[k : k + m]
                h *= _ODD[k]
                h ^= h >> np.uint32(15)
            found.append(h >> np.uint32(32 - BITS))
    edge = np.flatnonzero(np.diff((raw != 32).astype(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    if len(starts):
        up, down = _powers(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(raw.astype(np.uint64) * up[1:], dtype=np.uint64)])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(29)
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Vectors times output weights: a token's pull towards label 1, and the intercept.

    The mean over tokens and the output layer are both linear, so their product is all that scoring needs.
    """

    pull: np.ndarray
    intercept: float

    def score(self, texts) -> np.ndarray:
        z = []
        for t in texts:
            ids = tokens(t)
            z.append(self.intercept + (self.pull[ids].mean() if len(ids) else 0.0))
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def _counted(batches):
    for batch in batches:
        ids, times = [], []
        for t in batch.column("text").to_pylist():
            i, c = np.unique(tokens(t), return_counts=True)
            ids.append(i.astype("<u2" if BITS <= 16 else "<u4").tobytes())
            times.append(c.astype("<u4").tobytes())
        yield batch.column("y"), ids, times


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, epochs: int = EPOCHS) -> Model:
    """Train on the sample; with only one label known the model gives that label's side, with none 0.5 for all."""
    rows = map_arrow(labelled_sample(documents, labels, label, FOLDS, 0, per_class), _counted, "y int, ids binary, times binary").collect()
    rows.sort(key=lambda r: (r["y"], r["ids"], r["times"]))
    y = np.array([r["y"] for r in rows], int)
    size, rng = 1 << BITS, np.random.default_rng(7)
    if len(set(y)) < 2:
        return Model(np.zeros(size), 0.0 if not len(y) else 30.0 * (2 * y[0] - 1))
    docs = []
    for r in rows:
        ids, times = np.frombuffer(r["ids"], "<u2" if BITS <= 16 else "<u4"), np.frombuffer(r["times"], "<u4").astype(float)
        docs.append((ids, times / max(times.sum(), 1)))
    vectors, out, bias = rng.uniform(-1, 1, (size, DIM)) / DIM, np.zeros((DIM, 2)), np.zeros(2)
    share = len(y) / (2 * np.array([(y == 0).sum(), (y == 1).sum()]))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for k in rng.permutation(len(y)):
            ids, part = docs[k]
            mean = part @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= share[y[k]]
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # each token gets the step of its share of the mean, scaled up as means move slowly
            vectors[ids] -= (50 * rate * part)[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
