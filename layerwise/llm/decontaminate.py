"""Operator 5, benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Q = 7
EDIT_SHARE = 0.1  # edits allowed, as a share of a passage's characters
LEAST_SHARED = 8  # q-grams that a region must share at least; where the budget leaves fewer, the budget is lowered
SLICE_CHARS = 4_000_000  # characters of passages in one broadcast of at most 100 MB; larger benchmarks take several passes
CHUNK = 1 << 20  # characters of documents that are filtered at once; longer texts are cut with overlaps
NONE = 0xFFFFFFFF  # no character

_B = [np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in range(5)]


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(c: np.ndarray) -> np.ndarray:
    """Rolling 64-bit values of all Q-grams of code points (Q is 7: 4 + 3)."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    c = c.astype(np.uint64) + np.uint64(1)
    two = c[:-1] * _B[1] + c[1:]
    four = two[:-2] * _B[2] + two[2:]
    three = two[:-1] * _B[1] + c[2:]
    return (four[: len(c) - 6] * _B[3] + three[4:]) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """Passages and the q-grams that count for them: ``values`` in order, each one's rows ``ends[i]:ends[i + 1]`` of (item,
    at), and a bit for the top bits of each, so that nearly all q-grams of a document are passed over by one look-up."""

    ids: list[int]
    texts: list[str]
    budget: np.ndarray
    shared: np.ndarray
    shift: np.uint64
    bits: np.ndarray
    values: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    at: np.ndarray
    short: list[int]

    def look(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, place in ``values``) of those that are in the index."""
        slot = (values >> self.shift).astype(np.int64)
        pos = np.flatnonzero(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
        if not len(pos):
            return pos, pos
        head = np.minimum(np.searchsorted(self.values, values[pos]), len(self.values) - 1)
        fine = self.values[head] == values[pos]
        return pos[fine], head[fine]


def build(items: list[tuple[int, str]]) -> Index:
    """Index passages. k edits leave at least n - kQ of any n of a passage's q-grams intact, so the most frequent
    q-grams can go without loss as long as n - kQ stays above LEAST_SHARED."""
    ids, texts = [i for i, _ in items], [t for _, t in items]
    per = [grams(codes(t)) for t in texts]
    used, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *per]), return_counts=True)
    budget, shared, short, picked = [], [], [], []
    for n, (t, g) in enumerate(zip(texts, per, strict=True)):
        k = min(int(EDIT_SHARE * len(t)), max(0, (len(g) - LEAST_SHARED) // Q))
        slack = len(g) - k * Q - LEAST_SHARED
        keep = np.sort(np.argsort(counts[np.searchsorted(used, g)], kind="stable")[: len(g) - max(0, slack) // 2])
        budget.append(k)
        shared.append(max(1, len(keep) - k * Q))
        picked.append((np.full(len(keep), n, np.int32), keep.astype(np.int32), g[keep]))
        if not len(g):
            short.append(n)
    item, at, value = (np.concatenate([np.zeros(0, kind), *(p[i] for p in picked)]) for i, kind in enumerate((np.int32, np.int32, np.uint64)))
    order = np.argsort(value, kind="stable")
    values, counts = np.unique(value[order], return_counts=True)
    wide = max(16, int(np.ceil(np.log2(max(1, len(values)) * 16))))
    bits = np.zeros(1 << wide, bool)
    bits[(values >> np.uint64(64 - wide)).astype(np.int64)] = True
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return Index(ids, texts, np.array(budget, np.int64), np.array(shared, np.int64), np.uint64(64 - wide), np.packbits(bits, bitorder="little"), values, ends, item[order], at[order], short)


def distance(passage: np.ndarray, text: np.ndarray, lo: int, hi: int, most: int) -> int:
    """Least edits between the passage and any part of the text that starts on a diagonal in lo..hi (within ``most``
    of it at all times); ``most`` + 1 if there are more."""
    lo, hi = lo - most, hi + most
    width = hi - lo + 1
    padded = np.full(width + len(passage), NONE, np.uint32)
    a, b = max(0, lo), min(len(text), hi + len(passage))
    if a >= b:
        return most + 1
    padded[a - lo : b - lo] = text[a:b]
    ramp = np.arange(width)
    # a start before the text costs what the passage lacks there
    d = np.maximum(0, -(ramp + lo))
    for i in range(len(passage)):
        up = np.append(d[1:], most + 1) + 1
        d = np.minimum(up, d + (padded[i : i + width] != passage[i]))
        d = np.minimum.accumulate(d - ramp) + ramp
        if d.min() > most:
            return most + 1
    return int(d.min())


def _candidates(index: Index, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, band) that share enough q-grams with a text; a band is two budgets (plus one each) of diagonals wide
    and bands overlap by half, so the diagonals of an alignment within budget lie in one band."""
    pos, head = index.look(grams(c))
    first = index.ends[head].astype(np.int64)
    n = index.ends[head + 1] - first
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
    item, diagonal = index.item[flat].astype(np.int64), np.repeat(pos, n) - index.at[flat]
    enough = np.bincount(item, minlength=len(index.ids)) >= index.shared
    fine = enough[item]
    item, diagonal = item[fine], diagonal[fine]
    band = (diagonal + (1 << 31)) // (index.budget[item] + 1)
    key = np.concatenate([item << 33 | band, item << 33 | (band - 1)])
    key, n = np.unique(key, return_counts=True)
    item = key >> 33
    fine = n >= index.shared[item]
    item = item[fine]
    return item, (key[fine] & ((1 << 33) - 1)) * (index.budget[item] + 1) - (1 << 31)


def found(index: Index, text: str | None) -> dict[int, int]:
    """{passage id: fewest edits} of all passages within their budget of some region of the whole text."""
    text = normal(text)
    out: dict[int, int] = {}

    def add(n: int, edits: int) -> None:
        out[index.ids[n]] = min(edits, out.get(index.ids[n], edits))

    for n in index.short:
        if index.texts[n] in text:
            add(n, 0)
    if len(text) < Q:
        return out
    over = 2 * max((len(t) for t in index.texts), default=0) + 2
    c = codes(text)
    for start in range(0, max(1, len(c) - over), CHUNK):
        part = c[start : start + CHUNK + over]
        items, bands = _candidates(index, part)
        for n, lo in zip(items.tolist(), bands.tolist(), strict=True):
            if out.get(index.ids[n]) == 0:
                continue
            k, size = int(index.budget[n]), len(index.texts[n])
            near = text[start + max(0, lo - k) : start + lo + 2 * k + 2 + size + k] if lo + 2 * k + 2 + size > 0 else ""
            edits = 0 if index.texts[n] in near else distance(codes(index.texts[n]), part, lo, lo + 2 * k + 1, k) if k else 1
            if edits <= k:
                add(n, edits)
    return out


def _slices(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many slices of about SLICE_CHARS characters the passages make, and the slices; each broadcast has that bound."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    n = int((sized.agg(F.sum(F.length("t"))).first()[0] or 0) // SLICE_CHARS) + 1

    def rows() -> Iterator[list[tuple[int, str]]]:
        for k in range(n):
            some = [(r.i, normal(r.t)) for r in sized.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t").collect()]
            yield [(i, t) for i, t in some if t]

    return n, rows()


def _checked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with arrays __items and __edits: one narrow pass if the benchmark is one slice. Else each slice is
    a pass that keeps only texts with hits, by their SHA-256, so that no worker holds two slices."""
    spark = docs.sparkSession
    n, slices = _slices(benchmark)
    if n == 1:
        index = spark.sparkContext.broadcast(build(next(slices)))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = [found(index.value, x.as_py()) for x in b.column("text")]
                new = [pa.array([sorted(h) for h in hits], pa.list_(pa.int64())), pa.array([[h[i] for i in sorted(h)] for h in hits], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "__items", "__edits"])
            common.trim()

        types = docs.withColumns({"__items": F.lit(None).cast("array<long>"), "__edits": F.lit(None).cast("array<int>")}).schema
        return docs.mapInArrow(check, types)

    key = F.sha2(F.col("text").cast("string"), 256)
    hits = spark.createDataFrame([], "key string, item long, edits int")
    for rows in slices:
        index = spark.sparkContext.broadcast(build(rows))

        def look(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                some = [(k, i, e) for k, x in zip(b.column("key").to_pylist(), b.column("text"), strict=True) for i, e in found(index.value, x.as_py()).items()]
                yield pa.RecordBatch.from_pydict({"key": pa.array([x[0] for x in some], pa.string()), "item": pa.array([x[1] for x in some], pa.int64()), "edits": pa.array([x[2] for x in some], pa.int32())})
            common.trim()

        hits = hits.unionByName(common.stored(docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(look, "key string, item long, edits int"), "leaks"))
        index.unpersist()
    each = hits.groupBy("key", "item").agg(F.min("edits").alias("e")).groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("item", "e"))).alias("__h"))
    out = docs.withColumn("__own", key).join(each, F.col("__own") == F.col("__key"), "left")
    return out.select(*docs.columns, F.col("__h.item").alias("__items"), F.col("__h.e").alias("__edits"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending), edits (of each).

    Lower case and white space don't count. A passage is in a document if some region of it is within 10 % of the
    passage's characters in edits (insertions, deletions, changes); passages too short for that many edits to leave
    shared q-grams get a smaller budget, those under 7 characters none. Null texts hold nothing; null or blank passages
    and passages without an id match nothing; without passages no document is contaminated. Passages that repeat
    under several ids give all of them. Other columns are not read.
    """
    out = _checked(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    items = F.coalesce("__items", F.array().cast("array<long>"))
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce("__edits", F.array().cast("array<int>")).alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a passage of the benchmark, all columns as they were."""
    return _checked(docs, benchmark).where("coalesce(size(__items), 0) <= 0").drop("__items", "__edits")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
