"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q and a length of at least max(``SHORTEST``, 2 q) that no neighbouring
word extends. The words of many documents are put in one sequence, with a number of its own between two documents,
so no run crosses it.

At scale B (2, 4, 8, ...) the sequence is cut into blocks of B words. A run whose period is in the scale's range holds
a whole block that returns, equal, one period later: any 2 B - 1 words hold a whole block, and a run is longer than
its period by at least that. So for each block the sums of squared differences to all places of the following window
are computed exactly, from running sums of squares and one number-theoretic transform of block and window (codes are
kept so small that no sum reaches the modulus); where the sum is zero, the distance seeds a candidate. Many words may
share a code, so the words of such a block are compared themselves. Blocks whose first two words return nowhere in the
window are left out beforehand. Neighbouring blocks of one distance form a chain, which reaches less than B words beyond
its ends; these are compared word by word too, and what is long enough and has no smaller period is a run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from barloom.llm.common import map_arrow

SHORTEST = 12
WORDS = 1 << 18
TILE = 1 << 20
#: A prime with roots of unity of order 2^30, and a generator.
PRIME, ROOT = 3_221_225_473, 5
_P = np.uint64(PRIME)
_TWIDDLES: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, PRIME)) % _P
        size += more
    return out


def _twiddle(size: int, inverse: bool) -> np.ndarray:
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    if size > 1 << 14:
        return _powers(pow(root, -1, PRIME) if inverse else root, size // 2)
    if (size, inverse) not in _TWIDDLES:
        _TWIDDLES[size, inverse] = _powers(pow(root, -1, PRIME) if inverse else root, size // 2)
    return _TWIDDLES[size, inverse]


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in bit-reversed order."""
    size = x.shape[1]
    x = x.copy()
    span = size
    while span > 1:
        w = _twiddle(span, False)
        pair = x.reshape(len(x), size // span, 2, span // 2)
        a, b = pair[:, :, 0], pair[:, :, 1]
        total = a + b
        apart = (a + (_P - b)) % _P * w % _P
        pair[:, :, 0], pair[:, :, 1] = np.where(total >= _P, total - _P, total), apart
        span //= 2
    return x


def inverse_transform(x: np.ndarray) -> np.ndarray:
    """Of rows in bit-reversed order, the rows they were made from."""
    size = x.shape[1]
    x = x.copy()
    span = 2
    while span <= size:
        w = _twiddle(span, True)
        pair = x.reshape(len(x), size // span, 2, span // 2)
        a, b = pair[:, :, 0], pair[:, :, 1] * w % _P
        total, apart = a + b, a + (_P - b)
        pair[:, :, 0], pair[:, :, 1] = np.where(total >= _P, total - _P, total), np.where(apart >= _P, apart - _P, apart)
        span *= 2
    return x * np.uint64(pow(size, -1, PRIME)) % _P


def scales(longest: int):
    """(block length, least period, greatest period) up to half of the longest document."""
    block, least = 2, 1
    while least <= longest // 2:
        greatest = 6 if block == 2 else 4 * block - 2
        yield block, least, greatest
        block, least = 2 * block, greatest + 1


def squared_differences(codes: np.ndarray, starts: np.ndarray, block: int, least: int, greatest: int) -> np.ndarray:
    """Per block start and distance from ``least`` to ``greatest``, the exact sum of squared differences.

    ``codes`` is padded so that all windows lie in it; block * (largest code)^2 is below ``PRIME``.
    """
    size, places = 4 * block, greatest - least + 1
    one = np.zeros((len(starts), size), np.uint64)
    one[:, :block] = codes[starts[:, None] + np.arange(block)]
    window = np.zeros((len(starts), size), np.uint64)
    reach = places + block - 1
    window[:, :reach] = codes[(starts + least)[:, None] + np.arange(reach)]
    squares = np.zeros((len(starts), reach + 1), np.int64)
    np.cumsum(window[:, :reach].astype(np.int64) ** 2, axis=1, out=squares[:, 1:])
    # a block read backwards (around the circle) turns the product of transforms into a correlation
    one = np.concatenate([one[:, :1], one[:, :0:-1]], axis=1)
    cross = inverse_transform(transform(one) * transform(window) % _P)[:, :places].astype(np.int64)
    own = (one.astype(np.int64) ** 2).sum(1)
    return own[:, None] + squares[:, block : block + places] - squares[:, :places] - 2 * cross


def _pairs_return(words: np.ndarray):
    """A test whether the two words at a place return within a range of distances."""
    _, pair = np.unique(words[:-1] * (words.max() + 1) + words[1:], return_inverse=True)
    n = len(words)
    keys = np.sort(pair * n + np.arange(n - 1))

    def test(starts: np.ndarray, least: int, greatest: int) -> np.ndarray:
        base = pair[starts] * n
        at = np.minimum(np.searchsorted(keys, base + np.minimum(starts + least, n - 1)), len(keys) - 1)
        return (keys[at] >= base + starts + least) & (keys[at] <= base + np.minimum(starts + greatest, n - 1))

    return test


def _codes(block: int) -> int:
    """How many codes there are for words, so that no sum over a block reaches the modulus."""
    return int(((PRIME - 1) // block) ** 0.5)


def _seeds(words, starts, block, least, greatest):
    """(start, distance) of blocks whose codes return at a distance."""
    most = _codes(block)
    codes = np.concatenate([words % most, np.zeros(greatest + 2 * block, np.int64)]).astype(np.uint64)
    step = max(1, TILE // (4 * block))
    found = [(starts[:0], starts[:0])]
    for k in range(0, len(starts), step):
        part = starts[k : k + step]
        i, d = np.nonzero(squared_differences(codes, part, block, least, greatest) == 0)
        found.append((part[i], d + least))
    at, d = (np.concatenate(c) for c in zip(*found))
    inside = at + d + block <= len(words)
    return at[inside], d[inside]


def _reach(words: np.ndarray, at: np.ndarray, d: np.ndarray, block: int, side: int) -> np.ndarray:
    """How many words from ``at`` on (side 1), or before it (side -1), equal those ``d`` later; less than ``block`` + 1."""
    out = np.empty(len(at), np.int64)
    step = max(1, TILE // block)
    offsets = np.arange(block) if side > 0 else -1 - np.arange(block)
    for k in range(0, len(at), step):
        i = at[k : k + step, None] + offsets
        j = i + d[k : k + step, None]
        ok = (i >= 0) & (j < len(words))
        same = ok & (words[np.where(ok, i, 0)] == words[np.where(ok, j, 0)])
        out[k : k + step] = np.where(same.all(1), block, (~same).argmax(1))
    return out


def _primitive(words: np.ndarray, start: int, d: int) -> bool:
    """No proper divisor of ``d`` is a period of the ``d`` words repeated from ``start``."""
    left, prime = d, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        if left % prime == 0:
            q = d // prime
            if (words[start : start + 2 * d - q] == words[start + q : start + 2 * d]).all():
                return False
            while left % prime == 0:
                left //= prime
        prime += 1
    return True


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers whose parts are at most ``longest`` long."""
    runs: set[tuple[int, int, int]] = set()
    if len(words) < SHORTEST:
        return []
    returns, most = _pairs_return(words), words.max()
    end, period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    for block, least, greatest in scales(longest):
        starts = np.arange(0, len(words) - block + 1, block)
        starts = starts[returns(starts[starts < len(words) - 1], least, greatest)]
        at, d = _seeds(words, starts, block, least, greatest)
        # inside a run of a smaller period, its multiples have no run of their own
        known = (end[at] >= at + d + block) & (d % period[at] == 0)
        at, d = at[~known], d[~known]
        if most >= _codes(block):  # words share codes
            equal = _reach(words, at, d, block, 1) == block
            at, d = at[equal], d[equal]
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        if not len(at):
            continue
        first = np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] != at[:-1] + block)])
        last = np.concatenate([first[1:], [True]])
        begin, stop, d = at[first], at[last] + block, d[first]
        begin = begin - _reach(words, begin, d, block, -1)
        stop = stop + _reach(words, stop, d, block, 1)
        long = stop - begin >= np.maximum(SHORTEST - d, d)
        for s, e, q in sorted(zip(begin[long].tolist(), stop[long].tolist(), d[long].tolist()), key=lambda r: r[2]):
            run = s, e + q - s, q
            if run in runs or not _primitive(words, s, q):
                continue
            runs.add(run)
            seen = slice(s, e + q)
            wider = end[seen] < e + q
            end[seen][wider] = e + q
            period[seen][wider] = q
    return sorted((s, n, q) for s, n, q in runs)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rule that makes one document in ten periodic from some word on: places of the words to take; None for all others."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _report(prepare):
    def of(docs: list[tuple[int | None, list[bytes]]]):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        parts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for _, words in docs]
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths + 1)
        begins = ends - lengths - 1
        sequence = np.empty(ends[-1], np.int64)
        for part, b, e in zip(parts, begins, ends):
            sequence[b : e - 1] = part
        sequence[ends - 1] = len(numbers) + np.arange(len(docs))
        per_doc: dict[int, list] = defaultdict(list)
        for start, length, q in find_runs(sequence, int(lengths.max())):
            k = int(np.searchsorted(ends, start, "right"))
            per_doc[k].append((int(start - begins[k]), length, q))
        rows = []
        for k, (doc, words) in enumerate(docs):
            runs = per_doc.get(k, [])
            if runs:
                stay = collapsed(len(words), runs)
                words = [w for w, s in zip(words, stay.tolist()) if s]
                start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                top = start, length, q, 1000 * length // q
            else:
                top = None, None, None, None
            text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            rows.append((doc, len(runs), *top, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
        return tuple(list(c) for c in zip(*rows))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode().split() if text else []  # bytes are split at ASCII blanks only
                places = prepare(doc, len(words)) if prepare else None
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                held.append((doc, words))
                size += len(words)
                if size >= WORDS or len(held) >= 4096:
                    yield of(held)
                    held, size = [], 0
        if held:
            yield of(held)

    return run


def run_report(documents: DataFrame, prepare=None) -> DataFrame:
    """The runs of words of each row of ``documents`` (doc_id, text).

    Per row: doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then
    period; null without a run), runs_sha256 of all runs as text and collapsed_sha256 of the words that stay, joined by one
    blank. ``prepare(doc_id, words)`` may name the places of the words to take instead. A null text or one without words
    has no runs; a null doc_id is kept, and ``repeated_tail`` leaves its words alone; rows that repeat an id are judged each by
    its own text. Other columns are ignored; an empty table gives an empty result. A document stays in one
    task, its words in memory there.
    """
    columns = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_arrow(documents.select("doc_id", "text"), _report(prepare), columns)
