"""Random graphs drawn from one xorshift sequence, so that a seed names the same graph everywhere.

The sequence is linear over GF(2): a block of draws starts by a jump, so blocks are drawn apart from each other, in any
task and again after a loss. Work is that of all pairs, as the definition draws once for each; ``families.random_graph`` and
``families.block_graph`` have the same distributions in time linear in the edges. Covers SRC23-SRC26, with samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import numbered
from .families import both_ways

LANES = 1024  # draws of a block: LANES lanes of LANES consecutive draws


def step(v: np.ndarray) -> np.ndarray:
    v = v ^ v << np.uint64(13)
    v = v ^ v >> np.uint64(7)
    return v ^ v << np.uint64(17)


def _applied(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for j in range(64):
        out ^= columns[j] * (v >> np.uint64(j) & np.uint64(1))
    return out


@lru_cache(1)
def _powers() -> list[np.ndarray]:
    """The step's matrix to the power 2^i, as the images of the 64 single bits."""
    out = [step(np.uint64(1) << np.arange(64, dtype=np.uint64))]
    for _ in range(63):
        out.append(_applied(out[-1], out[-1]))
    return out


def jumped(v: np.ndarray, steps: int) -> np.ndarray:
    for i, m in enumerate(_powers()):
        if steps >> i & 1:
            v = _applied(m, v)
    return v


def block(seed: int, first: int) -> np.ndarray:
    """The LANES^2 draws from number ``first`` (0 is the first after the seed)."""
    lanes = jumped(np.array([max(seed, 1)], dtype=np.uint64), first)
    span = LANES
    while len(lanes) < LANES:
        lanes = np.concatenate([lanes, jumped(lanes, span)])
        span *= 2
    out = np.empty((LANES, LANES), dtype=np.uint64)
    for i in range(LANES):
        lanes = step(lanes)
        out[:, i] = lanes
    return out.reshape(-1)


def unit(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(11)).astype(np.float64) / 2.0**53


def bounded(v: np.ndarray, n: int) -> np.ndarray:
    """The high word of v * n, for n below 2^32."""
    high, low = v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)
    return (high * np.uint64(n) + (low * np.uint64(n) >> np.uint64(32)) >> np.uint64(32)).astype(np.int64)


def drawn(spark: SparkSession, draws: int, seed: int, use: Callable[[int, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``use(first, values)`` of every block, one task for a few blocks."""
    per = LANES * LANES
    blocks = -(-draws // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict(use(i * per, block(seed, i * per)[: draws - i * per]))

    return spark.range(0, blocks, 1, max(1, min(blocks, 4096))).mapInArrow(run, schema)


def _pairs(spark: SparkSession, n: int, seed: int, directed: bool, most: float, chance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> DataFrame:
    draws = n * (n - 1) // (1 if directed else 2)

    def use(first: int, values: np.ndarray) -> dict[str, np.ndarray]:
        u = unit(values)
        hit = np.flatnonzero(u < most)
        k = hit + first
        if directed:
            a, t = np.divmod(k, n - 1)
            b = t + (t >= a)
        else:
            before = lambda i: i * (n - 1) - i * (i - 1) // 2
            a = np.floor((2 * n - 1 - np.sqrt((2.0 * n - 1) ** 2 - 8.0 * k)) / 2).astype(np.int64)
            a -= before(a) > k  # the root is off by one at most
            a += before(a + 1) <= k
            b = a + 1 + k - before(a)
        keep = slice(None) if chance is None else u[hit] < chance(a, b)
        return {"src": a[keep], "dst": b[keep]}

    e = drawn(spark, draws, seed, use, "src long, dst long") if draws > 0 else spark.createDataFrame([], "src long, dst long")
    return e if directed else both_ways(e)


def random_graph(spark: SparkSession, n: int, degree: float, seed: int, directed: bool = False) -> DataFrame:
    """One draw for each pair in order: an edge below degree / (n - 1), an arc below degree / n."""
    return _pairs(spark, n, seed, directed, degree / (n if directed else max(n - 1, 1)), None)


def block_graph(spark: SparkSession, n: int, inside: float, across: float, seed: int) -> DataFrame:
    """Two blocks, split at n // 2; an edge below inside / n or across / n."""
    half = n // 2
    return _pairs(spark, n, seed, False, max(inside, across) / n, lambda a, b: np.where((a >= half) == (b >= half), inside / n, across / n))


def points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(id, x, y) in the unit square, two draws a point, for ``families.geometric``."""

    def use(first: int, values: np.ndarray) -> dict[str, np.ndarray]:
        u = unit(values)
        return {"id": first // 2 + np.arange(len(u) // 2), "x": u[::2], "y": u[1::2]}

    return drawn(spark, 2 * n, seed, use, "id long, x double, y double")


def small_world(spark: SparkSession, n: int, shortcuts: int, seed: int) -> DataFrame:
    """A ring with links to the next two, and the first ``shortcuts`` different links that the sequence draws and the ring
    lacks (two draws an attempt)."""
    free = n * (n - 1) // 2 - min(2 * n, n * (n - 1) // 2)
    if shortcuts > free:
        raise ValueError("more shortcuts than pairs")
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[(F.col("id") + k) % n for k in (1, 2)])).alias("dst")).where("src <> dst")

    def use(first: int, values: np.ndarray) -> dict[str, np.ndarray]:
        v = bounded(values, n)
        return {"attempt": first // 2 + np.arange(len(v) // 2), "a": np.minimum(v[::2], v[1::2]), "b": np.maximum(v[::2], v[1::2])}

    attempts = 2 * shortcuts + 64
    while shortcuts:
        tried = drawn(spark, 2 * attempts, seed, use, "attempt long, a long, b long")
        new = tried.where(f"b - a > 2 AND a + {n} - b > 2").groupBy("a", "b").agg(F.min("attempt").alias("attempt"))
        placed, found = numbered(new, ["attempt"], "place", "shortcuts")
        if found >= shortcuts:
            ring = ring.unionByName(placed.where(F.col("place") < shortcuts).select(F.col("a").alias("src"), F.col("b").alias("dst")))
            break
        attempts *= 2
    return both_ways(ring).distinct()


def regular_graph(spark: SparkSession, n: int, degree: int, seed: int, most: int = 1 << 20) -> tuple[DataFrame, int]:
    """(edges, attempts): a random simple regular graph. The half-edges 0, 0, .., 1, 1, .. are shuffled from the end, each with
    one of those up to it, by draws modulo the count that pass over the first 2^64 mod count values; neighbours in the
    shuffled row are paired; a loop or a repeated edge starts the next attempt, with the next draws. One shuffle has one
    order, so it is drawn on the driver, for at most ``most`` half-edges."""
    halves = n * degree
    if halves % 2 or not 0 <= degree < max(n, 1) or halves > most:
        raise ValueError("REGULAR_GRAPH_SHAPE")
    first, held, at, attempts = 0, block(seed, 0).tolist(), 0, 0
    while halves:
        attempts += 1
        row = [v for v in range(n) for _ in range(degree)]
        for end in range(halves - 1, 0, -1):
            while True:
                if at == len(held):
                    first, at = first + len(held), 0
                    held = block(seed, first).tolist()
                value, at = held[at], at + 1
                if value >= (1 << 64) % (end + 1):
                    break
            k = value % (end + 1)
            row[k], row[end] = row[end], row[k]
        pairs = {(min(a, b), max(a, b)) for a, b in zip(row[::2], row[1::2], strict=True) if a != b}
        if len(pairs) == halves // 2:
            return both_ways(spark.createDataFrame(sorted(pairs), "src long, dst long")), attempts
    return spark.createDataFrame([], "src long, dst long"), 0
