"""Operator 4, SimHash near-dedup over a Gray-order hierarchical index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

SHINGLE, SEED, DISTANCE = 3, 42, 3
BLOCK_BITS = 16  # four masked patterns of 16 bits: two fingerprints within 3 bits agree in one of them
LEAF, FAN = 32, 16  # fingerprints of a leaf node, nodes of an upper node
TEXTS = 512  # documents that are handed over at once where a pipeline's other stages need the memory
PIECE = 1 << 20  # bytes of a text that are cut into words at once
_SPACE = re.compile(rb"[ \t-\r]")
DEEP = 20_000  # fingerprints under one pattern beyond which the 48 other bits are factored into patterns as well


def _shingles(text: str | None) -> Iterator[list[bytes]]:
    """The shingles of a text, in lists of a piece's own: long texts never stand in memory as words as well."""
    # bytes.lower changes A-Z only, and bytes.split breaks at U+0009 to U+000D and space only
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, carried, any_yet = 0, [], False
    while at < len(data):
        gap = _SPACE.search(data, at + PIECE)
        end = gap.end() if gap else len(data)
        words = [*carried, *data[at:end].split()]
        at = end
        if len(words) >= SHINGLE:
            yield [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
            any_yet = True
        carried = words[1 - SHINGLE :]
    if carried and not any_yet:
        yield [b" ".join(carried)]


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles of a text; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    n, ones = 0, np.zeros(64, np.int64)
    for some in _shingles(text):
        raw = np.array([xxh64_intdigest(x, SEED) for x in some], ">u8").view(np.uint8).reshape(-1, 8)
        n += len(some)
        for i in range(0, len(raw), 1 << 14):
            ones += np.unpackbits(raw[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed 64-bit fingerprints of a column of texts."""
    for texts in batches:
        yield pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).astype(np.int64))
    common.trim()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit value in the reflected Gray code: neighbours in that order differ in one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _nodes(keys: np.ndarray, shared: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, mask) of runs of ``per`` nodes: the bits that all below have in common."""
    at = np.arange(0, len(keys), per)
    ones, zeros = np.bitwise_and.reduceat(keys & shared, at), np.bitwise_and.reduceat(~keys & shared, at)
    return ones, ones | zeros


def _near(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the distinct ``values`` at most DISTANCE bits apart.

    Values are sorted by Gray rank, so that neighbours share long bit patterns. Leaf nodes of 32 and upper nodes of
    16 nodes factor those out as (pattern, mask). Pairs of nodes are followed downwards while the differences in bits
    that both nodes fix are at most DISTANCE. Linked leaves are compared in full; links go into a union-find, so
    what is kept grows with the values and not with their pairs.
    """
    keys = values[np.argsort(gray_rank(values), kind="stable")]
    levels = [_nodes(keys, np.full(len(keys), ~np.uint64(0)), LEAF)]
    while len(levels[-1][0]) > 64:
        levels.append(_nodes(*levels[-1], FAN))
    parent = np.arange(len(keys))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def close(level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pattern, mask = levels[level]
        fine = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= DISTANCE
        return a[fine], b[fine]

    def down(level: int, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 4096):  # bounded memory: a slice of pairs goes all the way down first
            x, y = a[at : at + 4096], b[at : at + 4096]
            if level:
                n, step = len(levels[level - 1][0]), np.arange(FAN)
                p, q = np.broadcast_arrays((x[:, None] * FAN + step)[:, :, None], (y[:, None] * FAN + step)[:, None, :])
                p, q = p.ravel(), q.ravel()
                fine = (p <= q) & (q < n)
                down(level - 1, *close(level - 1, p[fine], q[fine]))
                continue
            for i in range(0, len(x), 256):
                p, q = x[i : i + 256, None] * LEAF + np.arange(LEAF), y[i : i + 256, None] * LEAF + np.arange(LEAF)
                d = np.bitwise_count(keys[np.minimum(p, len(keys) - 1)][:, :, None] ^ keys[np.minimum(q, len(keys) - 1)][:, None, :]) <= DISTANCE
                k, u, v = np.nonzero(d)
                u, v = p[k, u], q[k, v]
                fine = (u < v) & (v < len(keys))
                for s, t in zip(u[fine].tolist(), v[fine].tolist(), strict=True):
                    s, t = root(s), root(t)
                    if s != t:
                        parent[max(s, t)] = min(s, t)

    top = len(levels) - 1
    for i in range(len(levels[top][0])):  # row by row, so that all pairs of top nodes never stand in memory
        other = np.arange(i, len(levels[top][0]))
        down(top, *close(top, np.full(len(other), i), other))
    roots = np.array([root(i) for i in range(len(keys))], np.int64)
    linked = roots != np.arange(len(keys))
    return keys[linked], keys[roots[linked]]


def _links(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values = np.concatenate([b.column("fp").to_numpy(zero_copy_only=False) for b in batches]).view(np.uint64)
    a, b = _near(values)
    if len(a):
        yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` within 3 bits, directly or through others.

    The top of the index is dealt out: each fingerprint goes under its four 16-bit patterns, one for each block, and
    pairs within 3 bits meet under at least one of them, so nothing is lost. A pattern with more than DEEP
    fingerprints is factored further by the four 12-bit patterns of its other bits, by the same argument.
    """
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1) for i in range(4)]
    under = distinct.select("fp", F.posexplode(F.array(*block)).alias("rotation", "pattern"))
    counts = common.stored(under.groupBy("rotation", "pattern").count().where("count > 1"), "patterns")
    under = under.join(counts, ["rotation", "pattern"])
    # the 48 bits that are left, in order from the block above, cut into four of 12
    rest = F.expr("(shiftrightunsigned(fp, (rotation + 1) * 16 % 64) | shiftleft(fp, (64 - (rotation + 1) * 16 % 64) % 64)) & 281474976710655")
    deep = F.when(F.col("count") > DEEP, F.array(*[F.shiftrightunsigned(rest, 12 * i).bitwiseAND(4095) + 4096 * (i + 1) for i in range(4)])).otherwise(F.array(F.lit(0).cast("long")))
    dealt = under.select("fp", "rotation", "pattern", F.explode(deep).alias("deep"))
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # small rows, much work: not to be coalesced
    return dealt.repartition(parts, "rotation", "pattern", "deep").groupBy("rotation", "pattern", "deep").applyInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), kept.

    Texts are lower-cased in A-Z and cut at ASCII white space; null and empty texts have fingerprint zero and link like
    any other. Rows that share a fingerprint are one node, so a group of exact copies costs one fingerprint. A
    null doc_id gets a component like any row but names none unless all ids of its component are null. ``kept`` marks
    the rows whose id names their component. Other columns are not read; an empty table gives an empty result.
    """
    fps = common.stored(docs.select(F.col("doc_id").cast("long"), fingerprints(F.col("text").cast("string")).alias("fp")), "fingerprints")
    return grouped(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(fps: DataFrame) -> DataFrame:
    """The rows of ``fps`` (doc_id, fp and what else they hold), the component_id of each and its ``class``: the
    component's smallest fingerprint, which tells components without an id apart."""
    nodes = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    joined = common.components(links(nodes.select("fp")))
    named = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = common.stored(named.join(least, "component").select("fp", "component_id", F.col("component").alias("class")), "classes")
    return fps.join(of, "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns as they were: one with the smallest doc_id, with the least fingerprint
    of those that share it. Rows that share a doc_id, or have none, are told apart by their texts, and rows that have
    both in common are one document."""
    # an id and a hash of the text name a row, so that one exchange of the texts serves the join and the repeated rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), F.sha2(text, 256)).alias("__keep")
    with common.small_batches(docs.sparkSession, TEXTS):
        fps = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key, fingerprints(F.col("text").cast("string")).alias("fp")), "fingerprints")
    # a row of a component: its smallest id first, none last
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "__keep"))["__keep"].alias("__keep")
    keep = grouped(fps).groupBy("class").agg(first).select("__keep").distinct()
    return docs.select("*", key).join(keep, "__keep", "left_semi").dropDuplicates(["__keep"]).select(docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
