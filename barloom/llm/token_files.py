"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A set of files is a folder with two Parquet tables. ``vocabulary`` maps rank to token id, the most frequent
id first. ``blocks`` holds runs of whole documents in ascending order: per id a code of two bits (its number of
bytes less one) in the control bytes, four to a byte, and one to four bytes of its rank in the data bytes.
Decoding looks each control byte up in a table of 256 x 4 lengths and gathers the data with numpy.

Blocks of a shard follow each other, shards follow each other, and a block records how many ids of its shard
precede it, so the place of a document in the whole stream needs one row a shard.
"""

from __future__ import annotations

import gc
import json
import re
import string
import uuid
import zlib
from array import array
from contextlib import contextmanager

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import map_arrow
from barloom.session import cut_lineage, shared_folder

END_ID = 2
BLOCK_IDS = 1 << 16
MEMORY = 192 << 20
_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
# A single blank between two other characters always starts a new piece of the byte-level splitter.
_CUT = re.compile(r"(?<=\S)\x20(?=\S)")
#: The public splitter of byte-level tokenizers and the letters they write bytes with; fixed values.
_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_ENDS = string.punctuation
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class Chunks(dict):
    """Ids of chunks that follow a blank; None where the blank was not safe to cut at.

    ``pieces`` keeps those pieces of the splitter that are not a word after a blank. Two chunks around a line's end are
    known by themselves, not together.
    """

    def __init__(self, model, whole, added: list[str], most: int):
        self.tokenize, self.whole, self.added, self.most, self.pieces, self.bytes = model.tokenize, whole, added, most, {}, 0

    def merged(self, piece: str) -> bytes:
        plain = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenize(plain)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece[1:].isalpha():
            return self[piece[1:]]
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self.merged(piece)
            self.bytes += len(piece) + len(ids) + 180
        return ids

    def adds(self, chunk: str) -> bool:
        for t in self.added:
            if t in chunk:
                return True
        return False

    def of(self, chunk: str) -> bytes:
        if self.adds(chunk):
            return self.whole(chunk)
        return b"".join(map(self.piece, _PIECES.findall(chunk)))

    def __missing__(self, chunk: str) -> bytes | None:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            ids = None
        elif self.adds(chunk):
            ids = self.whole(" " + chunk)
        elif chunk.isalpha():
            ids = self.merged(" " + chunk)
        else:
            left, line, right = chunk.partition("\n")
            if line and not left[-1].isspace() and not right[0].isspace():
                # Pieces end on both sides of such a line's end; its neighbours are remembered, their pair is seldom met again.
                return self[left] + self.piece(line) + (self.piece(right) if right.isalpha() else self.of(right))
            word = chunk.rstrip(_ENDS)  # marks after a word are one piece
            ids = self[word] + self.piece(chunk[len(word) :]) if word.isalpha() else self.of(" " + chunk)
        self[chunk] = ids
        self.bytes += len(chunk) + len(ids or b"") + 180
        return ids

    def forget(self):
        """Empty both memories when they take ``most`` bytes."""
        if self.bytes > self.most:
            self.clear()
            self.pieces.clear()
            self.bytes = 0


@contextmanager
def uncollected():
    """No search for cycles meanwhile: tokens and ids form none, and each search would walk all that is remembered."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Encoder:
    """Encodes texts with one tokenizer file, remembering the ids of chunks between single blanks and of pieces.

    Texts are cut only for byte-level tokenizers without prefix space or normaliser, where merges never cross
    the pieces of the splitter and pieces never cross such a blank; any other tokenizer encodes whole texts.
    Both memories are emptied when full. Ids are kept as little-endian unsigned 32-bit.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, added = spec["pre_tokenizer"] or {}, spec.get("added_tokens", [])
        self.by_chunk = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec["normalizer"] is None and spec["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        )
        self.chunks = Chunks(self.tokenizer.model, self._whole, [t["content"] for t in added], memory)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._whole(text)
        self.chunks.forget()
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise TypeError
            return self.chunks.of(first) + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:
            return b"".join(self.chunks.of(p if not k else " " + p) for k, p in enumerate(_CUT.split(text)))


_held: dict[str, Encoder] = {}


def held_encoder(run_id: str, path: str, memory: int = MEMORY) -> Encoder:
    """The encoder of a run, which the tasks that a worker is given one after the other share; other runs' are let go."""
    if run_id not in _held:
        let_go()
        _held[run_id] = Encoder(path, memory)
    return _held[run_id]


def let_go() -> None:
    _held.clear()


def _encode(path: str, end_id: int, memory: int, shared: bool):
    end, run_id = np.array([end_id], "<u4").tobytes(), uuid.uuid4().hex

    def run(batches):
        encoder = held_encoder(run_id, path, memory) if shared else Encoder(path, memory)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                with uncollected():
                    ids = [encoder.encode(t or "") + end for t in part.column("text").to_pylist()]
                wide = [np.frombuffer(x, "<u4") for x in ids]
                small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in wide]
                yield part.column("doc_id"), [len(x) for x in wide], [zlib.crc32(x) for x in ids], small

    return run


def _wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def _count(batches):
    let_go()  # all is encoded
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        parts = [_wide(ids, n) for ids, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist())]
        more = np.bincount(np.concatenate(parts)) if parts else total[:0]
        if len(more) > len(total):
            total = np.concatenate([total, np.zeros(len(more) - len(total), np.int64)])
        total[: len(more)] += more
    seen = np.flatnonzero(total)
    yield seen, total[seen]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    ranks = np.zeros(n, np.uint32)
    for k in range(4):
        ranks |= np.where(lengths > k, padded[at + k if n else at] << np.uint32(8 * k), 0).astype(np.uint32)
    return ranks


BLOCKS = "shard int, block int, start_in_shard long, n_ids int, doc_ids array<long>, lengths array<int>, control binary, data binary"


def _pack_shard(rank_of):
    def run(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs, parts, size = [], [], 0

        def flush():
            ranks = rank_of.value[np.concatenate(parts)]
            control, data = pack(ranks)
            return tuple([x] for x in (shard, block, start, size, docs[:], [len(p) for p in parts], control, data))

        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                parts.append(_wide(ids, n))
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
                    block, start, docs, parts, size = block + 1, start + size, [], [], 0
        if parts:
            yield flush()

    return run


def write_token_files(documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, memory: int = MEMORY, shared: bool = True) -> str:
    """Encode every whole text (null: empty), append ``end_id`` to each, write the files and return their folder.

    Documents are written in ascending doc_id order, null ids first; rows that repeat an id follow each other by
    the crc32 of their ids. Other columns are ignored; no documents give empty tables.
    A worker remembers words in up to ``memory`` bytes, for the whole run if
    ``shared``, else for a task. The one array sent to all tasks holds a rank per vocabulary id, so the tokenizer bounds it.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    tokens = cut_lineage(map_arrow(documents.select("doc_id", "text"), _encode(tokenizer_path, end_id, memory, shared), "doc_id long, n int, crc long, ids binary"))
    counts = map_arrow(tokens.select("n", "ids"), _count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [(rank, row["id"], row["n"]) for rank, row in enumerate(counts.orderBy(F.desc("n"), "id").collect())]
    spark.createDataFrame(ranked, "rank int, id long, n long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    rank_of = np.zeros(max((i for _, i, _ in ranked), default=0) + 1, np.uint32)
    for rank, i, _ in ranked:
        rank_of[i] = rank
    ordered = tokens.repartitionByRange("doc_id", "crc", "n").sortWithinPartitions("doc_id", "crc", "n")
    map_arrow(ordered, _pack_shard(spark.sparkContext.broadcast(rank_of)), BLOCKS).write.parquet(f"{folder}/blocks")
    return folder


def _unpack_blocks(id_of):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of.value[unpack(row["control"], row["data"], row["n_ids"])]
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                texts = [ids[b:e].astype("<u4").tobytes() for b, e in zip(begins, ends)]
                yield [row["shard"]] * len(texts), row["doc_ids"], begins + row["start_in_shard"], lengths, texts

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a folder of token files; ids little-endian unsigned 32-bit."""
    vocabulary = spark.read.schema("rank int, id long, n long").parquet(f"{folder}/vocabulary").orderBy("rank").select("id").collect()
    id_of = spark.sparkContext.broadcast(np.array([r["id"] for r in vocabulary], np.uint32))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = map_arrow(blocks, _unpack_blocks(id_of), "shard int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def token_report(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, memory: int = MEMORY, shared: bool = True) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens and the crc32 of each document's ids."""
    rows = read_token_files(documents.sparkSession, write_token_files(documents, tokenizer_path, end_id=end_id, memory=memory, shared=shared))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
