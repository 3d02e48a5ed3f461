"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import runs


def all_runs(words):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(12, 2 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found)


def expected(doc, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(words)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha(lines), sha(" ".join(keep)))


def texts(seed):
    rng, rows = random.Random(seed), []
    for k in range(120):
        alphabet = rng.choice([1, 2, 2, 3, 5, 40, 400])
        words = [f"w{rng.randrange(alphabet)}" for _ in range(rng.choice([1, 5, 13, 40, 90, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            unit = [f"u{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 3, 6, 7, 8, 14, 15, 31]))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: rng.randint(len(unit), max(len(unit), min(150, 5 * len(unit))) + 9)]
        if rng.random() < 0.3 and len(words) > 20:
            words[rng.randrange(len(words))] = "odd"
        rows.append((rng.randrange(5000), rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows + [(None, "a " * 30), (None, None), (1, None), (2, ""), (3, " \n "), rows[0], rows[0], (4, "a b " * 12), (5, "é 漢 " * 40), (6, "x " * 500), (7, "x " * 11), (8, "x " * 12)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_period(spark, seed, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 2000)
    rows = texts(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, period string").repartition(3)
    got = runs.run_report(docs, runs.repeated_tail).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(d, t) for d, t in rows), key=repr)
    assert runs.run_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", ["a" * 3000, "ab" * 900 + "c" + "ab" * 700, "abcab" * 300, "abaab" * 50 + "x" * 40 + "abaababaabaab" * 30])
def test_words_of_few_letters(words):
    numbers = np.array([ord(c) for c in words])
    assert runs.find_runs(np.append(numbers, 1000), len(words)) == all_runs(list(words))


def test_fibonacci_word_has_nested_runs():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    assert runs.find_runs(np.array([ord(c) for c in b]), len(b)) == all_runs(list(b))


def test_a_long_text_of_one_word():
    assert runs.find_runs(np.zeros(200_000, np.int64), 200_000) == [(0, 200_000, 1)]


@pytest.mark.parametrize("block, period", [(4, 7), (8, 30), (64, 127), (256, 600)])
def test_words_that_share_a_code(block, period):
    base = np.random.default_rng(block).permutation(900)[:period]
    for odd in range(0, period, max(1, period // 9)):
        words = np.tile(base, 5)
        words[3 * period + odd] += runs._codes(block)
        assert runs.find_runs(np.append(words, 10**6), len(words)) == all_runs(words.tolist())


def test_a_document_whose_end_shares_the_code_of_its_next_word(spark):
    block, period, n = 64, 127, 386
    before = (block - 1 - (n - period) - 1) % block  # words of the first text, so that the last word that returns ends a block
    numbers = before + n % period + runs._codes(block) - 1  # words in all, so that the second text's end gets that number
    rows = [(1, before, "a"), (3, n, "b"), (4, numbers - before - period, "c")]
    rows = [(doc, " ".join(f"{letter}{i % period if letter == 'b' else i}" for i in range(size))) for doc, size, letter in rows]
    got = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [tuple(r)[:5] for r in got] == [(1, 0, None, None, None), (3, 1, 0, n, period), (4, 0, None, None, None)]


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for block, least, greatest in runs.scales(300):
        most = int(((runs.PRIME - 1) // block) ** 0.5)
        codes = np.concatenate([rng.integers(0, most + 1, 900), np.zeros(greatest + 2 * block, np.int64)]).astype(np.uint64)
        codes[:2 * block] = most
        starts = np.arange(0, 600, block)
        got = runs.squared_differences(codes, starts, block, least, greatest)
        c = codes.astype(object)
        for k in (0, len(starts) - 1):
            s = starts[k]
            assert [int(x) for x in got[k]] == [sum((c[s + i] - c[s + d + i]) ** 2 for i in range(block)) for d in range(least, greatest + 1)]
        x = codes[: 4 * block][None]
        assert (runs.inverse_transform(runs.transform(x)) == x).all()
