"""Operator 1, token-ID / binary output: documents to context-mixed, range-coded id blocks and back."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .range_coder import read_block, write_block

TOKENIZER, END_ID = "word_bpe_49k.json", 2
BLOCK_IDS = 1 << 22  # a block closes when it holds so many ids; no document is split
SLOTS = 1 << 21  # pieces that a worker's table has room for; it starts afresh at half of them
BYTES = 1 << 19  # of text that are tokenized at once
POOL = 1 << 24  # ids that a worker's table remembers at most; longer pieces take room each time
RECENT = 1 << 15  # rows that are looked up first
SHORT = 16  # bytes of a piece that the table holds
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a little-endian word
LETTERS = " ".join([*(w := [chr(c) for c in range(97, 256) if chr(c).isalpha() and chr(c).islower()]), "".join(w)])  # of Latin-1, and a word of all
TEXTS = 512  # documents that are handed over at once

BLOCKS = "part int, block int, documents int, ids long, frame binary"
READ = "doc_id long, part int, block int, in_part long, n_tokens long, ids_crc32 long"


class _Encoder:
    """Texts to 16-bit ids by way of the tokenizer, each distinct piece once for as long as it is remembered.

    The tokenizer's own rules break at all white space and lower-case, so a text's ids are those of its lower-cased
    pieces between ASCII spaces and newlines, in a row. These are cut again where an ASCII mark follows a letter, as the
    rules break there. Texts are cut in NumPy, and pieces of up to SHORT bytes are looked up by these bytes and their
    number in an open-addressing table of fixed size, which starts afresh when it is half full. Only new and longer
    pieces reach the tokenizer: words of Latin-1 letters many at a time, parted by spaces and told apart by the ids that
    end a word, and without the rules, which leave such words as they are; others one by one. Texts with a special
    token's opening are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.bare = Tokenizer(self.tokenizer.model)  # the model behind the rules
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.bare.encode(LETTERS).ids != self.tokenizer.encode(LETTERS, add_special_tokens=False).ids:  # of another kind
            self.bare = self.tokenizer
        self.ends = None
        if model.get("end_of_word_suffix"):
            self.ends = np.zeros(1 << 16, bool)
            self.ends[[i for x, i in model["vocab"].items() if x.endswith(model["end_of_word_suffix"]) and i < 1 << 16]] = True
        self.reset()

    def reset(self) -> None:
        # a row for each slot: the piece's first and second eight bytes, its length, and where its ids are
        self.table = np.zeros((SLOTS, 4), np.uint64)
        self.recent = np.zeros((RECENT, 4), np.uint64)  # the last rows seen, by other bits of the hash: it stays in the cache
        self.pool, self.used, self.held = np.zeros(1 << 20, np.uint16), 0, 0

    def one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many of each) of pieces encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint16, int(n.sum())), n

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)[0].ids, np.uint16)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) and cuts[-1] == len(ids) else self.one(words)

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Places in the pool of the ids of new pieces: start * 2^32 + length."""
        plain = np.array([self.ends is not None and p.isalpha() and (p.isascii() or max(p) < "\u0100") for p in pieces], bool)
        spans = np.empty(len(pieces), np.uint64)
        for kind, encode in ((plain, self.words), (~plain, self.one)):
            if not kind.any():
                continue
            flat, n = encode(list(compress(pieces, kind)))
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint16)])
            self.pool[self.used : self.used + len(flat)] = flat
            spans[kind] = (self.used + np.cumsum(n) - n << 32) + n
            self.used += len(flat)
        return spans

    def slots(self, hashed: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, its row, known) of each piece: where it is, or the first free slot of its chain."""
        slot = (hashed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        rows = self.table.take(slot, 0)
        known = (rows[:, 0] == piece[0]) & (rows[:, 1] == piece[1]) & (rows[:, 2] == piece[2])
        left = np.flatnonzero(~known & (rows[:, 2] != 0))
        while len(left):
            slot[left] = at = (slot[left] + 1) & (SLOTS - 1)
            rows[left] = there = self.table[at]
            same = (there[:, 0] == piece[0][left]) & (there[:, 1] == piece[1][left]) & (there[:, 2] == piece[2][left])
            known[left[same]] = True
            left = left[~same & (there[:, 2] != 0)]
        return slot, rows, known

    def insert(self, hashed: np.ndarray, piece: np.ndarray, spans: np.ndarray) -> None:
        """Distinct new pieces; those that meet in a free slot take turns."""
        left = np.arange(piece.shape[1])
        while len(left):
            slot, _, _ = self.slots(hashed[left], piece[:, left])
            _, first = np.unique(slot, return_index=True)
            slot, some = slot[first], left[first]
            self.table[slot, :3], self.table[slot, 3] = piece[:, some].T, spans[some]
            left = np.delete(left, first)
        self.held += piece.shape[1]

    def cut(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of the pieces of lower-cased bytes."""
        some = np.zeros(len(raw) + 2, bool)  # neither space nor newline, one place on
        np.not_equal(raw, 32, some[1:-1])
        some[1:-1] &= raw != 10
        letter = raw - np.uint8(97) < 26
        mark = (raw - np.uint8(33) < 94) & ~letter & ~(raw - np.uint8(48) < 10)
        after = np.zeros(len(raw) + 1, bool)  # a mark after a letter
        np.logical_and(letter[:-1], mark[1:], after[1:-1])
        latin = np.flatnonzero((raw[:-2] == 0xC3) & mark[2:])  # U+00C0 to U+00FF but for two signs
        after[latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)] + 2] = True
        return np.flatnonzero(some[1:] & (~some[:-1] | after)), np.flatnonzero(some[:-1] & (~some[1:] | after))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        out: list = [None] * len(texts)
        some, size = [], 0
        for i, text in enumerate(texts):
            if b"<|" in text or len(text) >= BYTES:
                out[i] = self.one([text.decode("utf-8", "replace")])[0] if b"<|" in text else self.long(text)
                continue
            if size + len(text) + 1 > BYTES:
                self.batch(texts, some, out)
                some, size = [], 0
            some.append(i)
            size += len(text) + 1
        self.batch(texts, some, out)
        return out

    def long(self, text: bytes) -> np.ndarray:
        """A text of more than BYTES, cut at spaces or newlines; one without such is left to the tokenizer."""
        parts, at = [], 0
        while len(text) - at >= BYTES:
            stop = max(text.rfind(b" ", at, at + BYTES - 1), text.rfind(b"\n", at, at + BYTES - 1))
            if stop <= at:
                return self.one([text.decode("utf-8", "replace")])[0]
            parts.append(text[at:stop])
            at = stop
        return np.concatenate(self.encode([*parts, text[at:]]))

    def batch(self, texts: list[bytes], some: list[int], out: list) -> None:
        joined = b"\n".join([texts[i] for i in some]).lower()  # bytes.lower changes A-Z only
        start, stop = self.cut(np.frombuffer(joined, np.uint8))
        if self.held + len(start) > SLOTS // 2 or self.used > POOL:
            self.reset()
        length = stop - start
        words = np.ndarray((len(joined) + 9,), "<u8", joined + bytes(SHORT), 0, (1,))  # the eight bytes from each place
        piece = np.zeros((3, len(start)), np.uint64)
        piece[0], piece[2] = words[start] & MASK[np.minimum(length, 8)], length
        more = np.flatnonzero(length > 8)
        piece[1, more] = words[start[more] + 8] & MASK[np.minimum(length[more] - 8, 8)]
        hashed = (piece[0] ^ piece[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ piece[2]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        place = (hashed & np.uint64(RECENT - 1)).astype(np.int64)
        rows = self.recent.take(place, 0)
        known = (rows[:, 0] == piece[0]) & (rows[:, 1] == piece[1]) & (rows[:, 2] == piece[2])
        old = np.flatnonzero(~known)
        _, rows[old], known[old] = self.slots(hashed[old], piece[:, old])
        old = old[known[old]]
        self.recent[place[old]] = rows[old]
        spans = rows[:, 3]
        long = length > SHORT
        new = np.flatnonzero(~known & ~long)
        if len(new):
            _, first, back = np.unique(hashed[new], return_index=True, return_inverse=True)
            at = new[first]
            if not (piece[:, at][:, back] == piece[:, new]).all():  # two pieces of one hash: too rare to be clever about
                at, back = new, np.arange(len(new))
            found = self.learn(b" ".join([joined[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)]).decode("utf-8", "replace").split(" "))
            spans[new] = found[back]
            if len(at) == len(first):
                self.insert(hashed[at], piece[:, at], found)
        if long.any():
            at = np.flatnonzero(long)
            spans[at] = self.learn(b" ".join([joined[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)]).decode("utf-8", "replace").split(" "))
        n = (spans & np.uint64(0xFFFFFFFF)).astype(np.int32)  # the pool and a batch have fewer than 2^31 ids
        total = np.cumsum(n, dtype=np.int32)
        where = np.repeat((spans >> np.uint64(32)).astype(np.int32) - (total - n), n)
        where += np.arange(len(where), dtype=np.int32)
        flat = self.pool.take(where)
        ends = np.cumsum([len(texts[i]) + 1 for i in some])
        upto = np.concatenate([[0], total])[np.searchsorted(start, ends)]
        for i, a, b in zip(some, [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
            out[i] = flat[a:b]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _forget() -> None:
    """Drop the tables of a worker's encoders. Workers live on, and reading and other stages need that memory."""
    if _encoder.cache_info().currsize:
        _encoder.cache_clear()
        common.trim()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of all whole texts as block files under ``path``, in ascending doc_id order.

    Rows are range-partitioned by doc_id (rows of equal id by a hash of the text; null ids come first, and a null text
    is an empty one), then tokenized and coded in one pass. Every document ends with ``end_id``. An empty table
    writes no block. Columns other than doc_id and text are not read. The container is Parquet, so that any store
    which Spark writes will do; column ``frame`` is the format of range_coder.py. Only 16-bit vocabularies are taken.
    """
    tokenizer = tokenizer or tokenizer_path()
    end = np.array([end_id], "<u2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, encoder = TaskContext.get().partitionId(), 0, 0, _encoder(tokenizer)
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def close() -> pa.RecordBatch:
            lengths, whole = [len(x) for x in ids], np.concatenate(ids)
            ids.clear()  # not in memory twice while the block is coded
            common.trim()
            frame = write_block(names, lengths, whole, first)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "documents": pa.array([len(names)], pa.int32()), "ids": pa.array([held], pa.int64()), "frame": pa.array([frame], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for name, raw in zip(some.column("doc_id").to_pylist(), encoder.encode([x or b"" for x in some.column("text").cast(pa.binary()).to_pylist()]), strict=True):
                    ids.append(np.append(raw, end))
                    names.append(name)
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield close()
                        block, first, held, ids, names = block + 1, first + held, 0, [], []
        if ids:
            yield close()
        common.trim()

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.xxhash64("text"))
    with common.small_batches(docs.sparkSession, TEXTS):
        dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(encode, BLOCKS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the block files under ``path``: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers), part, block.

    Blocks are checked and decoded independently, in any order. A document's start is its offset in its part, which
    the frame holds, plus the sizes of the parts before: only one row per part is summed in order.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            for row in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("frame"), strict=True):
                first, names, lengths, ids = read_block(row[2].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "part": pa.array([row[0]] * n, pa.int32()), "block": pa.array([row[1]] * n, pa.int32()), "in_part": pa.array(first + starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
        common.trim()

    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = common.stored(before, "parts")  # of known size, so Spark broadcasts it only while it is small
    return (
        blocks.select("part", "block", "frame").mapInArrow(decode, READ).join(before, "part")
        .select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", "part", "block")
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the block files to the shared folder and read them back (see write_ids and read_ids)."""
    path = f"{common.shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir))
