"""Operator 10, toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import common

SAMPLE = 12_000  # labelled documents that the model is fitted on at most
LEAST_DOCS, PAIR_DOCS = 3, 8  # of the sample, that a term and a tested pair must be in
PREFIX = 4  # bytes of a longer word's prefix, a term as well, so that rare inflected forms share weight
HEAD = np.uint32(1 << 31)  # the bit of a prefix's hash
SCREEN = 4.0  # standard errors that a term's share of toxic documents must differ from the sample's
FACTORS, EPOCHS, BATCH, RATE, L2 = 8, 18, 256, 0.15, 1e-3
THRESHOLD = 0.7
STEPS = 800  # batches at least; small samples take more epochs

_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms(text: str | None) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct terms of a text: its words (letters and digits; A-Z lower-cased), words that
    occur again, and the first PREFIX bytes of longer words."""
    found = Counter(_TERM.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    again = [x + b"+" for x, n in found.items() if n > 1]
    heads = {x[:PREFIX] for x in found if len(x) > PREFIX}
    whole = np.fromiter(map(zlib.crc32, chain(found, again)), np.uint32, len(found) + len(again)) & ~HEAD
    return np.unique(np.concatenate([whole, np.fromiter(map(zlib.crc32, heads), np.uint32, len(heads)) | HEAD]))


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the inner products of their factors)."""

    bias: float
    known: np.ndarray  # sorted hashes
    weight: np.ndarray
    factor: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        found = [terms(x) for x in texts]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        flat = np.concatenate([np.zeros(0, np.uint32), *found])
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
            hit = self.known[at] == flat
            at, row = at[hit], row[hit]
        else:
            at = row = np.zeros(0, np.int64)
        return _sigmoid(_raw(self.bias, self.weight, self.factor, at, row, len(texts))[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _raw(bias, weight, factor, at, row, n):
    sums = np.stack([np.bincount(row, factor[at, f], n) for f in range(factor.shape[1])], 1)
    squares = np.bincount(row, (factor[at] ** 2).sum(1), n)
    return bias + np.bincount(row, weight[at], n) + ((sums**2).sum(1) - squares) / 2, sums


def _encoded(known: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
    """The places in ``known`` of each document's terms that are in it."""
    if not len(known):
        return [np.zeros(0, np.int64)] * len(found)
    rows = []
    for x in found:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        rows.append(at[known[at] == x])
    return rows


def _paired(rows: list[np.ndarray], size: int, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of ``size`` terms are in a pair whose documents are toxic more or less often than the linear model's ``p``
    and both terms' own shares explain. All pairs in PAIR_DOCS documents are tested, by the Chernoff bound of a sum
    of unequal Bernoulli draws, so that one pair at most is expected by chance. One term's pairs stand in memory."""
    # the most frequent terms first: a pair is met at its more frequent term, so a rare term has few pairs of its own
    of_term = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=size)
    by = np.argsort(-of_term, kind="stable")
    place = np.empty(size, np.int64)
    place[by] = np.arange(size)
    rows = [np.sort(place[x]) for x in rows]
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    size_of = np.array([len(x) for x in rows], np.int64)
    who = np.repeat(np.arange(len(rows)), size_of)
    order = np.argsort(flat, kind="stable")
    docs, behind = who[order], (np.arange(len(flat)) - np.repeat(np.cumsum(size_of) - size_of, size_of))[order] + 1
    ends = np.cumsum(of_term[by])
    own = np.bincount(flat, y[who], size) / np.maximum(of_term[by], 1)
    tested, found = 0, []
    for a, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if end - start < PAIR_DOCS:
            break
        of, at = docs[start:end], behind[start:end]
        other, each = np.concatenate([rows[j][k:] for j, k in zip(of.tolist(), at.tolist(), strict=True)]) - a, np.repeat(of, size_of[of] - at)
        if len(other) < size // 8:  # few: those that aren't in PAIR_DOCS of the documents go first
            in_order = np.sort(other)
            runs = in_order[: max(0, len(other) - PAIR_DOCS + 1)]
            often = np.unique(runs[runs == in_order[len(other) - len(runs) :]])
            if not len(often):
                continue
            at = np.minimum(np.searchsorted(often, other), len(often) - 1)
            hit = often[at] == other
            other, each, b = at[hit], each[hit], often + a
            n = np.bincount(other, minlength=len(often))
            q, m = (np.bincount(other, v[each], len(often)) / n for v in (y, p))
        else:
            n = np.bincount(other, minlength=size - a)
            b = np.flatnonzero(n >= PAIR_DOCS)
            q, m = (np.bincount(other, v[each], size - a)[b] / n[b] for v in (y, p))
            n, b = n[b], b + a
            if not len(b):
                continue
        tested += len(b)
        high, low = np.maximum(m, np.maximum(own[a], own[b])), np.minimum(m, np.minimum(own[a], own[b]))
        m = np.clip(np.where(q > high, high, np.where(q < low, low, q)), 1e-6, 1 - 1e-6)
        bound = n * (q * np.log(np.maximum(q, 1e-12) / m) + (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - m)))
        fine = bound > np.log(max(tested, 2))  # the number so far, less than that of all: the last test is below
        found += [(a, j, x) for j, x in zip(b[fine].tolist(), bound[fine].tolist(), strict=True)]
    in_pair = np.zeros(size, bool)
    for a, b, bound in found:
        if bound > np.log(max(tested, 2)):
            in_pair[by[[a, b]]] = True
    return in_pair


def fit(found: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Log loss, AdaGrad. Terms whose share of toxic documents is SCREEN standard errors off that of all documents weigh
    alone: a third of the epochs fits their linear weights. All pairs are then tested against that model, however little
    their terms say alone, and the last two thirds fit weights and factors together for the terms of both kinds."""
    y = labels.astype(float)
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.0
    bias = np.log(share / (1 - share)) if len(y) else -35.0
    known, n_docs = np.unique(np.concatenate([np.zeros(0, np.uint32), *found]), return_counts=True)
    known, n_docs = known[n_docs >= LEAST_DOCS], n_docs[n_docs >= LEAST_DOCS]
    if not len(y) or not len(known) or y.min() == y.max():
        return Machine(bias, known[:0], np.zeros(0), np.zeros((0, FACTORS)))
    third, gb = max(EPOCHS, -(-STEPS * BATCH // len(y))) // 3, 1e-6

    def fitted(rows, weight, factor, epochs):
        nonlocal bias, gb
        gw, gf = np.full(len(weight), 1e-6), np.full(factor.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick = order[i : i + BATCH]
                at, row = np.concatenate([rows[j] for j in pick]), np.repeat(np.arange(len(pick)), [len(rows[j]) for j in pick])
                z, sums = _raw(bias, weight, factor, at, row, len(pick))
                e = (_sigmoid(z) - y[pick]) / len(pick)
                gb += e.sum() ** 2
                bias -= RATE * e.sum() / np.sqrt(gb)
                g = np.bincount(at, e[row], len(weight))
                seen = g != 0
                gw[seen] += g[seen] ** 2
                weight = weight - 2 * RATE * g / np.sqrt(gw)
                if factor.any():
                    h = np.stack([np.bincount(at, e[row] * (sums[row, f] - factor[at, f]), len(weight)) for f in range(FACTORS)], 1) + L2 * factor * seen[:, None]
                    gf += h**2
                    factor = factor - RATE / 3 * h / np.sqrt(gf)
        return weight, factor

    rows = _encoded(known, found)
    toxic = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(y, [len(x) for x in rows]), len(known))
    alone = np.abs(toxic - n_docs * share) > SCREEN * np.sqrt(n_docs * share * (1 - share))
    weight, few = np.zeros(len(known)), _encoded(known[alone], found)
    weight[alone], _ = fitted(few, weight[alone], np.zeros((int(alone.sum()), 1)), third)
    p = _sigmoid(bias + np.array([weight[alone][x].sum() for x in few]))
    often = np.flatnonzero((n_docs >= PAIR_DOCS) & (known < HEAD))  # a prefix is in too many pairs to say more than its words
    stay = alone.copy()
    stay[often] |= _paired(_encoded(known[often], found), len(often), y, p)
    known, weight = known[stay], weight[stay]
    if not len(known):
        return Machine(float(bias), known, weight, np.zeros((0, FACTORS)))
    weight, factor = fitted(_encoded(known, found), weight, rng.normal(0, 0.05, (len(known), FACTORS)), 2 * third)
    return Machine(float(bias), known, weight, factor)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on at most SAMPLE labelled documents outside the held-out fold (crc32 of the id mod 3 is 1), chosen by a hash
    of their ids. A label counts if it isn't null; several labels of a document count as their majority."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.in_fold("doc_id", 3, 1))
        .groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(x.as_py()).view(np.int32) for x in b.column("text")]
            yield pa.RecordBatch.from_pydict({"id": b.column("__id"), "y": b.column("__y"), "key": b.column("__key"), "terms": pa.array(found, pa.list_(pa.int32()))})
        common.trim()

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("__id", "__y", F.xxhash64("text").alias("__key"), "text").mapInArrow(read, "id long, y int, key long, terms array<int>")
    # of rows that share an id the one with the least hash; at most SAMPLE rows
    got = got.groupBy("id").agg(F.min(F.struct("key", "y", "terms")).alias("x")).select("id", "x.y", "x.terms").toArrow().to_pandas().sort_values("id")
    return fit([np.asarray(x, np.int32).view(np.uint32) for x in got["terms"]], got["y"].to_numpy())


def scorer(machine: Machine):
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(machine.score(list(texts)))
        common.trim()

    return score


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.7).

    Null and empty texts get the score of a text without known terms; a null doc_id isn't held out; without any
    usable label every score is about 0. Repeated rows are scored alike; other columns are not read.
    """
    out = docs.select(F.col("doc_id"), common.in_fold("doc_id", 3, 1).alias("held_out"), scorer(machine)(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't reject, all columns as they were."""
    return docs.where(scorer(train(docs, labels))(F.col("text").cast("string")) < THRESHOLD)
