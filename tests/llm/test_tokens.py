"""Token files: the encoder against whole-text encoding, and exact round trips."""

import gc
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b\n\n c ", " x", "x ", "a\n b", "a<|endoftext|> b <|endoftext|>", "it's  'll  x\x1c y", "\u3000 a", "e\u0301 \u0e01\u0e33 \U0001f600!? ..", "3.14 a.b, c.\nD", "A!? b?!"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_text_encoding(name):
    whole, encoder, rng = Tokenizer.from_file(public_tokenizers.path(name)), token_files.Encoder(public_tokenizers.path(name)), random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\t ab'1.,é!?ſ\x85") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for t in texts:
        assert encoder.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packing_round_trip(n):
    ranks = np.random.default_rng(n).choice(np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32), n)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == ranks).all()


def expected(rows):
    whole, out, start = Tokenizer.from_file(PATH), [], 0
    coded = []
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        coded.append((doc is not None, doc, zlib.crc32(ids), len(ids) // 4))
    for _, doc, crc, n in sorted(coded, key=lambda r: (r[0], r[1] or 0, r[2], r[3])):
        out.append((doc, start, n, crc))
        start += n
    return out


def test_files_read_back_as_written(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    rows = [(7 * k % 101, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (3, "other"), (None, "no id"), (None, None), (500, None), (501, "long word " * 30_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ids string, start int").repartition(3)
    got = sorted(map(tuple, token_files.token_report(docs, PATH).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_vocabulary_is_ranked_by_frequency(spark):
    docs = spark.createDataFrame([(1, "the the the cat"), (2, "the cat")], "doc_id long, text string")
    folder = token_files.write_token_files(docs, PATH)
    counts = [r.n for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True)


def test_no_documents(spark):
    assert token_files.token_report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_tasks_of_a_run_share_what_a_worker_remembers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    one = token_files.held_encoder("run 1", path)
    one.encode("a word")
    assert token_files.held_encoder("run 1", path) is one and "word" in one.chunks
    assert token_files.held_encoder("run 2", path) is not one and list(token_files._held) == ["run 2"]
    list(token_files._count(iter(())))
    assert not token_files._held


def test_memory_is_emptied_when_full():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), memory=1000)
    texts = [f"some words w{k} x{k} y{k}" for k in range(50)]
    whole = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.encode(t) for t in texts] == whole and len(encoder.chunks) < 15


def test_added_tokens_of_letters(tmp_path):
    whole = Tokenizer.from_file(PATH)
    whole.add_tokens(["cat", "!!"])
    whole.save(str(tmp_path / "t.json"))
    encoder = token_files.Encoder(str(tmp_path / "t.json"))
    for t in ("a cat sat", "a concatenation b", "b dog!! x", "c end.\ncat d", "d cat!!\nno e"):
        assert encoder.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_parted_chunks_equal_whole_text_encoding():
    whole, encoder, rng = Tokenizer.from_file(PATH), token_files.Encoder(PATH), random.Random(8)
    bits = ["word", "\n", ".", "!!", "'s", "'", "$%", "\r\n", "é", "7", "\x1c", "Next", "-", "<|endoftext|>", " "]
    for _ in range(3000):
        t = "a " + "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        assert encoder.encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_no_search_for_cycles_while_encoding():
    assert gc.isenabled()
    with token_files.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()
