"""Checksummed layer archives: a header of 48 bytes, then frames of 80 bytes with a payload and a SHA-256 each.

Header: eight bytes of magic that end in the variant (AR1: states and 128-bit hashes; AS3: states; AS2: samples of up to
1,000 states a layer, at the end perhaps the last layer whole), width (u64), configuration digest (32 bytes). Frame: eight
bytes of magic ending in FR1, kind, depth, count, payload bytes, sequence (u64 each), the digest of what went before
(32 bytes). Kinds: 1 records, 2 layer commit, 3 run commit, 4 replace the last layer.

Archives are read twice, frame by frame: the first pass checks the chain and finds the committed layers, the second hands
their states on, so that no more than one frame is in memory. Covers SRC27, SRC28, SNK2, FL12.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RECORDS, LAYER, RUN, REPLACE = 1, 2, 3, 4
_FIELDS = struct.Struct("<5Q")
SAMPLED, WIDEST, FRAME_BYTES = 1_000, 33_025, 1 << 28
SCHEMA = "path string, config string, depth int, ordinal long, state binary"


class ArchiveError(ValueError):
    pass


@dataclass
class Head:
    variant: bytes
    width: int
    config: str
    chain: bytes = field(repr=False)

    @property
    def record(self) -> int:
        return self.width + (16 if self.variant == b"AR1" else 0)


def read_head(source: BinaryIO) -> Head:
    raw = source.read(48)
    if len(raw) < 48:
        raise ArchiveError("ARCHIVE_HEADER")
    head = Head(raw[5:8], struct.unpack_from("<Q", raw, 8)[0], raw[16:48].hex(), hashlib.sha256(raw).digest())
    if head.variant not in (b"AR1", b"AS2", b"AS3") or not 0 < head.width <= WIDEST:
        raise ArchiveError("ARCHIVE_HEADER")
    return head


def frames(source: BinaryIO, chain: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(kind, depth, count, payload) of the frames after the header, the digest chain and sequence checked."""
    number = 0
    while head := source.read(80):
        if len(head) < 80:
            raise ArchiveError("ARCHIVE_TRUNCATED")
        kind, depth, count, size, sequence = _FIELDS.unpack_from(head, 8)
        if head[5:8] != b"FR1" or sequence != number or head[48:] != chain:
            raise ArchiveError("ARCHIVE_CHAIN")
        if size > FRAME_BYTES:
            raise ArchiveError("ARCHIVE_FRAME_SIZE")
        payload, tail = source.read(size), source.read(32)
        if len(tail) < 32:
            raise ArchiveError("ARCHIVE_TRUNCATED")
        digest = hashlib.sha256(head)
        digest.update(payload)
        chain = digest.digest()
        if tail != chain:
            raise ArchiveError("ARCHIVE_CHECKSUM")
        yield kind, depth, count, payload
        number += 1


def committed(source: BinaryIO, whole: bool = True) -> tuple[Head, list[tuple[int, int, int]]]:
    """(header, layers as (states, first frame, frame of the commit)) of an archive. With ``whole`` the run must be
    committed, else what follows the last committed layer is left out, as is a replacement that isn't whole."""
    head = read_head(source)
    layers: list[tuple[int, int, int]] = []
    rows = first = 0
    old = None  # the layer that is being replaced
    replaced = done = False
    try:
        for number, (kind, depth, count, payload) in enumerate(frames(source, head.chain)):
            if done or depth != len(layers) - (kind == REPLACE) or (replaced and old is None and kind != RUN):
                raise ArchiveError("ARCHIVE_CHAIN")
            if kind == RECORDS:
                if not count or len(payload) != count * head.record or (head.variant == b"AS2" and old is None and rows + count > SAMPLED):
                    raise ArchiveError("ARCHIVE_RECORD_SHAPE")
                first = first if rows else number
                rows += count
            elif kind == LAYER:
                if payload or count != rows:
                    raise ArchiveError("ARCHIVE_LAYER_COUNT")
                layers.append((rows, first if rows else number, number))
                rows, old = 0, None
            elif kind == REPLACE and head.variant == b"AS2":
                if payload or count or rows or not layers or replaced:
                    raise ArchiveError("ARCHIVE_FRAME_KIND")
                old, replaced = layers.pop(), True
            elif kind == RUN:
                if payload or rows or not layers or count != sum(n for n, _, _ in layers):
                    raise ArchiveError("ARCHIVE_RUN_COUNT")
                done = True
            else:
                raise ArchiveError("ARCHIVE_FRAME_KIND")
    except ArchiveError:
        if whole:
            raise
    if whole and not done:
        raise ArchiveError("ARCHIVE_TRUNCATED")
    return head, layers + ([old] if old else [])


def states(source: BinaryIO, layers: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(depth, ordinal of the first, states) of each records frame of the committed layers, from the header on."""
    head = read_head(source)
    spans = [(first, last, depth) for depth, (_, first, last) in enumerate(layers)]
    at, ordinal = 0, 0
    for number, (kind, _, count, payload) in enumerate(frames(source, head.chain)) if spans else ():
        if kind == RECORDS and number >= spans[at][0]:
            # states stand first, the hashes of AR1 after all of them
            yield spans[at][2], ordinal, [payload[i * head.width : (i + 1) * head.width] for i in range(count)]
            ordinal += count
        if number == spans[at][1]:
            at, ordinal = at + 1, 0
            if at == len(spans):  # what follows isn't committed, and needn't be whole
                return


def decode(raw: bytes, whole: bool = True) -> tuple[str, list[tuple[int, list[bytes]]]]:
    """(configuration digest, committed layers) of an archive in memory."""
    head, layers = committed(io.BytesIO(raw), whole)
    out: list[list[bytes]] = [[] for _ in layers]
    for depth, _, some in states(io.BytesIO(raw), layers):
        out[depth] += some
    return head.config, list(enumerate(out))


class Writer:
    """Appends frames to a stream; nothing beyond ``capacity`` bytes is begun."""

    def __init__(self, target: BinaryIO, width: int, config: bytes, magic: bytes = b"LAYERAS3", capacity: int | None = None) -> None:
        self.target, self.width, self.magic, self.capacity, self.held = target, width, magic, capacity, 0
        self.layers: list[int] = []
        self.rows, self.number = 0, 0
        head = magic + struct.pack("<Q", width) + config
        self._put(head)
        self.chain = hashlib.sha256(head).digest()

    def _put(self, data: bytes) -> None:
        if self.capacity is not None and self.held + len(data) > self.capacity:
            raise ArchiveError("ARCHIVE_CAPACITY")
        self.target.write(data)
        self.held += len(data)

    def _add(self, kind: int, depth: int, count: int, payload: bytes = b"") -> None:
        head = self.magic[:5] + b"FR1" + _FIELDS.pack(kind, depth, count, len(payload), self.number) + self.chain
        chain = hashlib.sha256(head + payload).digest()
        self._put(head + payload + chain)
        self.chain, self.number = chain, self.number + 1

    def records(self, some: list[bytes], batch: int = 65_536) -> None:
        if any(len(s) != self.width for s in some):
            raise ArchiveError("ARCHIVE_RECORD_SHAPE")
        for i in range(0, len(some), batch):
            self._add(RECORDS, len(self.layers), len(some[i : i + batch]), b"".join(some[i : i + batch]))
        self.rows += len(some)

    def commit_layer(self) -> None:
        self._add(LAYER, len(self.layers), self.rows)
        self.layers.append(self.rows)
        self.rows = 0

    def replace_last_layer(self) -> None:
        if self.magic[5:] != b"AS2" or not self.layers or self.rows:
            raise ArchiveError("ARCHIVE_FRAME_KIND")
        self._add(REPLACE, len(self.layers) - 1, 0)
        self.layers.pop()

    def commit_run(self) -> None:
        self._add(RUN, len(self.layers), sum(self.layers))


def encode(layers: list[list[bytes]], width: int, config: bytes, magic: bytes = b"LAYERAS3", batch: int = 65_536, last: list[bytes] | None = None, capacity: int | None = None) -> bytes:
    """An archive of whole layers of states, committed; ``last`` replaces the last one (AS2)."""
    out = io.BytesIO()
    w = Writer(out, width, config, magic, capacity)
    for some in layers:
        w.records(some, batch)
        w.commit_layer()
    if last is not None:
        w.replace_last_layer()
        w.records(last, batch)
        w.commit_layer()
    w.commit_run()
    return out.getvalue()


def opened(uri: str):
    """A stream of a file that Spark has listed, by pyarrow's file systems."""
    import pyarrow.fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path)


def read_archives(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, config, depth, ordinal, state) of archive files. A chain has one order, so a file is one task's work; it is
    streamed, at most one frame (FRAME_BYTES) at a time. Every executor must reach the files by pyarrow."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with opened(name) as f:
                    head, layers = committed(f, whole)
                with opened(name) as f:
                    for depth, first, some in states(f, layers):
                        n = len(some)
                        yield pa.RecordBatch.from_pydict({"path": pa.array([name] * n), "config": pa.array([head.config] * n), "depth": pa.array([depth] * n, pa.int32()), "ordinal": pa.array(range(first, first + n), pa.int64()), "state": pa.array(some, pa.binary())})

    # only the paths are asked for, so Spark reads no content
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(read, SCHEMA)
