"""Operator 6, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, then calibrated by one
temperature on a part of the sample that training doesn't see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 3_000  # labelled documents that the weights are fitted on at most; document frequencies cover all of the fold
BITS = 15  # n-grams of 1 to 3 characters are hashed to 32,768 columns
EPOCHS, BATCH, ALPHA, BETA, L1, L2 = 6, 32, 0.5, 1.0, 2e-3, 1e-3
PIECE = 1 << 20  # characters that are counted at once
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]+")  # letters, and numerals that aren't decimal digits
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, lower-cased."""
    counts = np.zeros(1 << BITS, np.int64)
    shift = np.uint32(32 - BITS)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for start in range(0, len(c), PIECE):
        x = c[start : start + PIECE + 2]
        n = min(PIECE, len(c) - start)
        one = x * _A
        two = (one[:-1] ^ (x[1:] + np.uint32(7))) * _B
        three = (two[:-1] ^ (x[2:] + np.uint32(13))) * _C
        for h in (one[:n], two[:n], three[:n]):
            counts += np.bincount(h >> shift, minlength=1 << BITS)
    return counts


def has_letter(text: str | None) -> bool:
    """Whether any character is of Unicode category L: superscripts, fractions and number letters aren't."""
    return any(c.isalpha() for m in _LETTER.finditer(text or "") for c in m[0])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weight: np.ndarray  # columns x languages
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        table = np.column_stack([self.weight * self.idf[:, None], self.idf])
        names, scores = [], []
        for text in texts:
            if not self.langs or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            z = grams(text) @ table
            z = (z[:-1] / max(z[-1], 1e-12) + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            names.append(self.langs[best])
            scores.append(float(p[best]))
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray) -> Model:
    """``rows``: columns and counts of each document. Vectors are TF-IDF, scaled to sum 1."""
    classes = sorted(set(langs))
    y = np.array([classes.index(x) for x in langs], np.int64)
    dims, k = len(idf), len(classes)
    if k < 1:
        return Model([], idf, np.zeros((dims, 0)), np.zeros(0), 1.0)
    vectors = [(at, n * idf[at] / max(float((n * idf[at]).sum()), 1e-12)) for at, n in rows]
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    apart, use = order[: len(y) // 5], order[len(y) // 5 :]
    # a row of weights for each column and one for the bias, which carries no penalty
    z, n, w = (np.zeros((dims + 1, k)) for _ in range(3))

    def dense(pick: np.ndarray) -> np.ndarray:
        x = np.zeros((len(pick), dims + 1))
        for i, j in enumerate(pick):
            x[i, vectors[j][0]] = vectors[j][1]
        x[:, -1] = 1
        return x

    scale = 100.0  # vectors sum to 1, so gradients are small: the learner sees them a hundred times as large
    for _ in range(EPOCHS):
        for i in range(0, len(use), BATCH):
            pick = use[i : i + BATCH]
            x = dense(pick)
            x[:, :-1] *= scale
            p = _softmax(x @ w)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = x.T @ p / len(pick)
            s = (np.sqrt(n + g**2) - np.sqrt(n)) / ALPHA
            z += g - s * w
            n += g**2
            w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
            w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
    weight, bias = w[:-1] * scale, w[-1]
    temperature = 1.0
    if len(apart):
        raw = np.concatenate([dense(apart[i : i + 256])[:, :-1] @ weight + bias for i in range(0, len(apart), 256)])
        loss = lambda t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(apart)), y[apart]], 1e-12)).mean()
        temperature = min((float(t) for t in np.geomspace(0.05, 20, 121)), key=loss)
    return Model(classes, idf, weight, bias, temperature)


def train(docs: DataFrame) -> Model:
    """Document frequencies of all rows outside the held-out fold (crc32 of the id mod 5 is 0), weights from at most
    SAMPLE of those that have a language, chosen by a hash of their ids. Rows with a null id are in no fold and are
    not learned from."""
    known = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~common.in_fold("id", 5, 0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_in = 0, np.zeros(1 << BITS, np.int64)
        for b in batches:
            for x in b.column("text"):
                total += 1
                docs_in += grams(x.as_py()) > 0
        at = np.flatnonzero(docs_in)
        yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *at.tolist()], pa.int64()), "n": pa.array([total, *docs_in[at].tolist()], pa.int64())})

    df = {r["at"]: r["n"] for r in known.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # one row per column at most
    total, n = df.pop(-1, 0), np.zeros(1 << BITS)
    n[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + n)) + 0.1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, counts = [], []
            for x in b.column("text"):
                g = grams(x.as_py())
                at.append(np.flatnonzero(g).astype(np.int32))
                counts.append(g[at[-1]].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "lang": b.column("lang"), "key": b.column("key"), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(counts, pa.list_(pa.int32()))})

    # ids first, so that the sort holds no texts; ties are rows of one id, of which one is learned from
    chosen = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = known.join(F.broadcast(chosen), "id", "left_semi").select("id", "lang", F.xxhash64("text").alias("key"), "text")
    sample = sample.mapInArrow(counted, "id string, lang string, key long, at array<int>, n array<int>")
    # of rows that share an id the one with the least hash; at most SAMPLE rows
    got = sample.groupBy("id").agg(F.min(F.struct("key", "lang", "at", "n")).alias("x")).select("id", "x.lang", "x.at", "x.n").toArrow().to_pandas().sort_values("id")
    return fit([(np.asarray(a), np.asarray(c, float)) for a, c in zip(got["at"], got["n"], strict=True)], list(got["lang"]), idf)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no labelled row was there to
    learn from. A null doc_id isn't held out. Only the text enters a prediction; other columns are not read.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = docs.select("doc_id", common.in_fold("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identified(docs, train(docs))
