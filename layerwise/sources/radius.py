"""Links between points at most a radius apart, counted for each point without listing pairs. Covers SRC25, JN10 with
``families.geometric``, which lists them.

Points go to square tiles two radii wide, with all points within a radius of the tile. Inside, a finer grid is sorted by
lines of cells: of each line, the cells that lie within the radius as a whole are one range and counted by its ends, and
only points of cells that the circle may cut are compared. With cells that shrink as points grow denser, work grows as
the points to the power 1.5, where that of the pairs is quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialized

CHUNK, GROUP_ROWS = 50_000, 20_000  # points of a tile that one task counts for; rows of a task, about
FINEST, TESTS = 256, 1 << 16  # cells in a radius at most; pairs compared at a time
SLACK, FARTHEST = 1e-3, 2.0**40  # cells that rounding may move a point by, for coordinates of so many cells at most


def _cells(v: np.ndarray, tile: np.ndarray, parts: int, radius: float, torus: bool) -> tuple[np.ndarray, int]:
    """Cells of a coordinate and their number around the torus; in the plane from 0 in each tile, and 0."""
    if torus:
        n = max(1, math.ceil(parts / radius))
        return np.floor(v * n).astype(np.int64) % n, n
    c = np.floor(v * (parts / radius)).astype(np.int64)
    low = np.full(tile.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, tile, c)
    return c - low[tile], 0


def _lines(tile: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the points by tile, row and column; in that order each point's line, and the first point of each line."""
    order = np.lexsort((col, row, tile))
    t, r = tile[order], row[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _density(tile: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, torus: bool) -> float:
    """Points in a square as wide as the radius, in the mean over points."""
    row, col = _cells(y, tile, 1, radius, torus)[0], _cells(x, tile, 1, radius, torus)[0]
    order, line, _ = _lines(tile, row, col)
    c = col[order]
    new = np.ones(len(c), bool)
    new[1:] = (line[1:] != line[:-1]) | (c[1:] != c[:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(c)))
    return float((sizes.astype(float) ** 2).sum() / len(c))


def _places(keys: np.ndarray, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """How many of the sorted keys, which are below ``size``, are less than each of some numbers: from a table, if it isn't
    much larger than the keys."""
    if size > 8 * len(keys) + 65_536:
        return lambda v: np.searchsorted(keys, v)
    return np.searchsorted(keys, np.arange(size + 1)).__getitem__


def within(tile: np.ndarray, x: np.ndarray, y: np.ndarray, copies: np.ndarray, own: np.ndarray, radius: float, torus: bool, parts: int | None = None) -> np.ndarray:
    """For each point, if ``own``, the copies of points of its tile at most ``radius`` apart, its own included, or else 0.
    Tiles are numbered; ``parts`` cells make a radius (by default a number that suits the density)."""
    far = max(1.0, float(np.abs(x).max()), float(np.abs(y).max()))
    parts = parts or round(0.9 * math.sqrt(_density(tile, x, y, radius, torus)))
    parts = int(max(1, min(parts, FINEST, FARTHEST * radius / far)))
    (row, n), (col, _) = _cells(y, tile, parts, radius, torus), _cells(x, tile, parts, radius, torus)
    long = radius * n if torus else float(parts)  # the radius in cells
    reach = int(long + 1 + SLACK)
    # keys are line * wide + column; in the plane with a margin that no range leaves
    high = n or int(row.max()) + 1 + 2 * reach
    wide = n or int(col.max()) + 1 + 2 * reach
    if not torus:
        row, col = row + reach, col + reach
    order, line, first = _lines(tile, row, col)
    tile, x, y, row, col, copies = tile[order], x[order], y[order], row[order], col[order], copies[order]
    lines, key = tile[first] * high + row[first], line * wide + col
    total = np.concatenate([[0], np.cumsum(copies)])
    place, line_of = _places(key, len(lines) * wide), _places(lines, (int(tile.max()) + 1) * high)
    mine, single = np.flatnonzero(own[order]), bool((copies == 1).all())
    counts = np.zeros(len(x), np.int64)

    def compare(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        ends = np.cumsum(hi - lo)
        i = 0
        while i < len(at):
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + TESTS, "right")))
            size = (hi - lo)[i:j]
            stop = ends[i:j] - before
            b = np.arange(stop[-1]) + np.repeat(lo[i:j] - (stop - size), size)
            d, e = np.repeat(x[at[i:j]], size) - x[b], np.repeat(y[at[i:j]], size) - y[b]
            if torus:
                d, e = np.abs(d), np.abs(e)
                d, e = np.minimum(d, 1 - d), np.minimum(e, 1 - e)
            hit = d * d + e * e <= radius**2
            sums = np.concatenate([[0], np.cumsum(hit if single else hit * copies[b])])
            counts[at[i:j]] += sums[stop] - sums[stop - size]
            i = j

    def ranged(at: np.ndarray, base: np.ndarray, start: np.ndarray, end: np.ndarray, sure: bool) -> None:
        lo, hi = place(base + start), place(base + end)
        if sure:
            counts[at] += total[hi] - total[lo]
        elif (some := hi > lo).any():
            compare(at[some], lo[some], hi[some])

    around = torus and 2 * reach + 1 >= n
    for step in range(n) if around else range(-reach, reach + 1):
        apart = min(step, n - step) if around else abs(step)
        outer, inner = long**2 - max(apart - 1 - SLACK, 0) ** 2, long**2 - (apart + 1 + SLACK) ** 2
        if outer < 0:
            continue
        out, sure = int(math.sqrt(outer) + 1 + SLACK), math.floor(math.sqrt(max(inner, 0)) - 1 - SLACK)
        want = tile[mine] * high + ((row[mine] + step) % n if torus else row[mine] + step)
        found = np.minimum(line_of(want), len(lines) - 1)
        hit = lines[found] == want
        at, base, c = mine[hit], found[hit] * wide, col[mine[hit]]
        if not len(at):
            continue
        if torus and 2 * out + 1 >= n:  # a whole line of the torus, each cell once
            cut = [(-sure, sure, True), (sure + 1, n - 1 - sure, False)] if 0 <= sure and 2 * sure + 1 < n else [(0, n - 1, sure >= 0)]
        else:
            cut = [(-sure, sure, True), (-out, -sure - 1, False), (sure + 1, out, False)] if sure >= 0 else [(-out, out, False)]
        for a, b, whole in cut:
            start = (c + a) % n if torus else c + a
            end = start + (b - a + 1)
            ranged(at, base, start, np.minimum(end, n) if torus else end, whole)
            if torus and (over := end > n).any():
                ranged(at[over], base[over], np.zeros_like(end[over]), end[over] - n, whole)
    out = np.empty_like(counts)
    out[order] = counts
    return out


def _number(t: pa.Table, *names: str) -> np.ndarray:
    """The rows' keys as numbers from 0."""
    out = np.zeros(t.num_rows, np.int64)
    for c in names:
        at = t.column(c).combine_chunks().dictionary_encode()
        at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
        out = np.unique(out * len(at.dictionary) + at.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)[1]
    return out


def _within(nodes: DataFrame, rows: int, radius: float, torus: bool) -> DataFrame:
    """(id, x, y, copies, near) of nodes (world, id, x, y, copies): copies within the radius in the same world, own ones too."""
    wide, margin = 2 * radius * (1 + 1e-6), radius * (1 + 1e-6)
    most = max(1, int(1 / wide))
    side = 1 / most if torus else wide

    def tile(c, shift: float = 0.0):
        return F.floor((c + shift) / side)

    def wrap(c):
        return F.pmod(c, F.lit(most).cast("long")) if torus else c

    def spans(c: str):
        return F.array_distinct(F.transform(F.sequence(tile(F.col(c), -margin), tile(F.col(c), margin)), wrap))

    placed = nodes.select("*", wrap(tile(F.col("x"))).alias("hx"), wrap(tile(F.col("y"))).alias("hy"), F.pmod(F.xxhash64("id", "x", "y"), F.lit(1 << 32)).alias("h"))
    # tiles of more than CHUNK points, of which there are few, are counted for by several tasks
    full = placed.groupBy("world", F.col("hx").alias("tx"), F.col("hy").alias("ty")).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    full = full.withColumn("chunks", F.ceil(F.col("n") / CHUNK)).drop("n")
    dealt = placed.withColumn("tx", F.explode(spans("x"))).withColumn("ty", F.explode(spans("y")))
    dealt = dealt.join(F.broadcast(full), ["world", "tx", "ty"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    own = (F.col("tx") == F.col("hx")) & (F.col("ty") == F.col("hy")) & (F.col("h") % F.col("chunks") == F.col("chunk"))
    groups = max(1, 4 * rows // GROUP_ROWS)
    dealt = dealt.select("world", "tx", "ty", "chunk", "id", "x", "y", "copies", own.alias("own"), F.pmod(F.xxhash64("world", "tx", "ty", "chunk"), F.lit(groups)).alias("group"))

    def count(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, y, copies, mine = (t.column(c).to_numpy() for c in ("x", "y", "copies", "own"))
        near = within(_number(t, "world", "tx", "ty", "chunk"), x, y, copies, mine, radius, torus)
        yield from t.select(["id", "x", "y", "copies"]).append_column("near", pa.array(near)).filter(pa.array(mine)).combine_chunks().to_batches()

    kind = nodes.schema["id"].dataType.simpleString()
    return dealt.repartition(groups, "group").groupBy("group").applyInArrow(count, f"id {kind}, x double, y double, copies long, near long")


def degrees(points: DataFrame, radius: float, torus: bool = False) -> DataFrame:
    """(id, x, y, copies, links): of each distinct point (id, x, y) its rows, and the rows with another id at most ``radius``
    apart, in the plane or on the unit torus. Points with a null or a coordinate that isn't finite link with nothing and
    are left out. A task has the points of a tile and around it in memory."""
    finite = F.abs("x") < float("inf")  # false for NaN, which is the largest
    points = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite & (F.abs("y") < float("inf")) & F.col("id").isNotNull())
    nodes, n = materialized(points.groupBy("id", "x", "y").agg(F.count("*").alias("copies")), "points")
    near = _within(nodes.withColumn("world", F.lit(0)), n, radius, torus)
    several = nodes.join(nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "id", "left_semi")
    if several.isEmpty():
        return near.select("id", "x", "y", "copies", (F.col("near") - F.col("copies")).alias("links"))
    same = _within(several.withColumn("world", F.col("id")), n, radius, torus).select("id", "x", "y", F.col("near").alias("same"))
    return near.join(same, ["id", "x", "y"], "left").select("id", "x", "y", "copies", (F.col("near") - F.coalesce("same", "copies")).alias("links"))
