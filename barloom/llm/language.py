"""Language identification by unigram piece models with all segmentations summed out.

The pieces are all those of a fixed public byte-level vocabulary, and the 256 bytes. A word is what stands between
blanks, punctuation and marks included; with one blank before it, it is any sequence of pieces that spells it. Its
probability in a language is the sum over all such sequences, computed by a forward pass over the whole word that
looks back as far as the longest piece and keeps logarithms, so that words of any length are scored alike. Piece probabilities per language are learned by expectation maximisation with the
forward-backward pass, on word counts of a bounded sample: about ``PER_LANGUAGE`` documents of each language, chosen
by a hash of the id. Time grows with the bytes of a word; a text without blanks is one word.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fold, map_arrow
from barloom.llm.supervised import even_share

FOLDS, HELD = 4, 2
PER_LANGUAGE = 400
ROUNDS = 4
#: Longest piece that a vocabulary may have; one with a longer piece is an error.
PIECE = 64
#: Bytes of the words taken at a time.
CELLS = 250_000
SMOOTH = 0.1
REMEMBERED = 300_000
_WORDS = re.compile(r"\S+")
_ANY_LETTER = regex.compile(r"\p{L}")
_STEP = np.uint64(0x100000001B3)


class Pieces:
    """Piece ids of byte strings, looked up by hash in an open table."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
        found = sorted(found | {bytes([b]) for b in range(256)})
        self.size, self.longest = len(found), max(map(len, found))
        if self.longest > PIECE:
            raise ValueError(f"a piece has {self.longest} bytes")
        keys = np.array([self.hash_of(p) for p in found], np.uint64)
        if len(set(keys.tolist())) != len(keys):
            raise ValueError("two pieces share a hash")
        self.bits = int(len(keys) * 8).bit_length()
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for i, key in enumerate(keys.tolist()):
            at, probes = self.slot(key), 1
            while self.ids[at] >= 0:
                at, probes = (at + 1) % len(self.ids), probes + 1
            self.keys[at], self.ids[at] = key, i
            self.probes = max(self.probes, probes)

    @staticmethod
    def hash_of(piece: bytes) -> int:
        h = len(piece)
        for b in piece:
            h = (h * int(_STEP) + b + 1) % (1 << 64)
        return h

    def slot(self, key: int) -> int:
        return key * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(keys.shape, -1, np.int32)
        for k in range(self.probes):
            ids = self.ids[at]
            hit = (self.keys[at] == keys) & (ids >= 0)
            out[hit] = ids[hit]
            if not k and not (ids >= 0).any():
                break
            at = (at + 1) % len(self.ids)
        return out


def word_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return flat, lengths


def lattice(pieces: Pieces, flat: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Per byte j, triples (start, rows, ids): the pieces from ``start`` that end before j, and the words that have them."""
    n, width = flat.shape
    bytes_ = flat.astype(np.uint64) + np.uint64(1)
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
    for size in range(1, min(pieces.longest, width) + 1):
        keys = np.full((n, width - size + 1), size, np.uint64)
        for k in range(size):
            keys = keys * _STEP + bytes_[:, k : width - size + 1 + k]
        ids = pieces.find(keys)
        starts, rows = np.nonzero((ids.T >= 0) & (np.arange(width - size + 1)[:, None] + size <= lengths))
        ids = ids[rows, starts]
        rows = rows.astype(np.int32)
        cuts = np.flatnonzero(np.diff(starts, prepend=-1))
        for start, lo, hi in zip(starts[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(starts)]):
            out[start + size].append((start, rows[lo:hi], ids[lo:hi]))
    return out


def batches_of(words: list[bytes]):
    """Numbers of the words, shortest first, in groups of about ``CELLS`` bytes when padded to one length."""
    sizes = [len(w) for w in words]
    some: list[int] = []
    for i in np.argsort(sizes, kind="stable").tolist():
        if some and (len(some) + 1) * sizes[i] > CELLS:
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def forward_logs(ends: list, chances: np.ndarray, n: int, depth: int):
    """Per byte j from 1, the log of the sum over all segmentations of each word's first j bytes, one column a language.

    Words shorter than j hold no meaning there. Only the last ``depth`` bytes are kept.
    """
    logs = {0: np.zeros((n, chances.shape[1]))}
    for j in range(1, len(ends)):
        # half-way between the two ends of what is looked back at, so that neither leaves the range of a double
        level = (logs[j - 1] + logs[max(0, j - depth)]) / 2
        total = np.zeros_like(level)
        for start, rows, ids in ends[j]:
            total[rows] += np.exp(logs[start][rows] - level[rows]) * chances[ids]
        logs[j] = np.log(np.maximum(total, 1e-300)) + level
        logs.pop(j - depth, None)
        yield logs[j]


@dataclass
class Model:
    """Languages in code-point order and, per language, piece probabilities with a last row of zero for "no piece"."""

    languages: list[str]
    chances: np.ndarray
    path: str
    _pieces: Pieces | None = None
    _memory: dict = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "chances": self.chances, "path": self.path, "_pieces": None, "_memory": {}, "_scores": None}

    def pieces(self) -> Pieces:
        if self._pieces is None:
            self._pieces = Pieces(self.path)
        return self._pieces

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        out = np.zeros((len(words), len(self.languages)))
        for some in batches_of(raw):
            flat, lengths = word_matrix([raw[i] for i in some])
            ends, some = lattice(self.pieces(), flat, lengths), np.array(some)
            for j, logs in enumerate(forward_logs(ends, self.chances, len(some), self.pieces().longest), 1):
                whole = lengths == j
                if whole.any():
                    out[some[whole]] = logs[whole]
        return out

    def predict(self, texts) -> tuple[list[str], list[float]]:
        langs, chances = [], []
        if len(self._memory) > REMEMBERED or self._scores is None:
            self._memory, self._scores = {}, np.zeros((0, max(len(self.languages), 1)))
        split = [_WORDS.findall((t or "").lower()) if self.languages else [] for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self._memory))
        if new:
            start = len(self._memory)
            self._scores = np.concatenate([self._scores, self.word_scores(new)])
            self._memory.update(zip(new, range(start, start + len(new))))
        for t, ws in zip(texts, split):
            if not ws or not _ANY_LETTER.search(t):
                langs.append("und")
                chances.append(0.0)
                continue
            z = self._scores[np.fromiter(map(self._memory.__getitem__, ws), np.int64, len(ws))].sum(0)
            p = np.exp(z - z.max())
            best = int(z.argmax())
            langs.append(self.languages[best])
            chances.append(float(p[best] / p.sum()))
        return langs, chances


def _count_words(batches):
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words, times = np.unique(np.array(_WORDS.findall((text or "").lower()), dtype=object), return_counts=True)
            yield [lang] * len(words), list(words), list(times)


def fit(documents: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Learn from text and non-null lang of the documents outside the held-out fold (a null id is not learnt from).

    The languages are the labels seen; their number is taken to be small, one column each. No documents: no languages.
    """
    known = documents.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, per_language / counts[lang]).otherwise(share)
    words = map_arrow(known.filter(even_share("doc_id") < share).select("lang", "text"), _count_words, "lang string, word string, n long")
    rows = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    model = Model(languages, np.zeros((0, 0)), path)
    size = model.pieces().size
    tables = []
    for lang in languages:
        own = rows[rows.lang == lang].sort_values("word")
        tables.append(_learn(model.pieces(), size, list(own.word), own.n.to_numpy(float), rounds))
    model.chances = np.zeros((size + 1, len(languages)))
    for k, t in enumerate(tables):
        model.chances[:-1, k] = t
    return model


def _learn(pieces: Pieces, size: int, words: list[str], times: np.ndarray, rounds: int) -> np.ndarray:
    """Piece probabilities that make the words likely, with ``SMOOTH`` added to every piece's count."""
    raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    chance = np.full(size, 1.0 / size)
    if not raw:
        return chance
    blocks = []
    for some in batches_of(raw):
        flat, lengths = word_matrix([raw[i] for i in some])
        blocks.append((lattice(pieces, flat, lengths), lengths, times[some]))
    for _ in range(rounds):
        expected = np.zeros(size)
        for ends, lengths, n in blocks:
            logs = [np.zeros(len(lengths)), *(x[:, 0] for x in forward_logs(ends, chance[:, None], len(lengths), pieces.longest))]
            # the share of all segmentations of a word that have a boundary at byte j
            passed = [np.where(lengths == j, 1.0, 0.0) for j in range(len(ends))]
            for j in range(len(ends) - 1, 0, -1):
                for start, rows, ids in ends[j]:
                    flow = passed[j][rows] * chance[ids] * np.exp(logs[start][rows] - logs[j][rows])
                    passed[start][rows] += flow
                    np.add.at(expected, ids, flow * n[rows])
        expected += SMOOTH
        chance = expected / expected.sum()
    return chance


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, lang_pred, score (probability of the prediction).

    A null text, an empty one and one without a letter get ``und`` and 0; a null doc_id is kept with held_out null;
    repeated rows are judged alike; other columns are ignored; an empty table gives an empty result.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, chances = held.value.predict(list(texts))
        return pd.DataFrame({"lang": langs, "score": chances})

    rows = documents.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
