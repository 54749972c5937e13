"""Complete searches, layer by layer: implicit orbits, explicit edge tables, labeled and target searches.

A layer step over an orbit is one exchange. The children of a layer, and the history that they must not be in, go into
one aggregation by state, which keeps states that only children have:

    children(F[d]) as (state, 1)  union  history as (state, 0)  ->  group by state  ->  min(tag) = 1

History is the two layers before if the generators are provably inverse-closed, all layers otherwise. Map-side
aggregation removes duplicates before the exchange. Layers are Parquet in the shared folder, so a lost
executor costs a task and never the search.

Covers BF1-BF5, BF8, BF13, BF16, BF20, BF22, JN1, JN2, JN7, ST1-ST5, SO1, SO5, SO6, AG1, AG2, PR3.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..functions.bounds import orbit_bound
from ..plans.session import discard, materialized, numbered, sized, wrapping
from ..plans.spec import GraphError, GraphSpec

DRIVER_STATES = 65_536  # orbits that are proved to be no larger may be searched on the driver
DRIVER_CHILDREN = 1 << 20  # of a layer in the hybrid lane that the driver steps itself: 8 MB
DRIVER_HELD = 1 << 23  # retained states of the hybrid lane that stay on the driver: 64 MB
DRIVER_ARCS = 1 << 22  # of an edge table that may be searched on the driver: 64 MB


@dataclass
class Layers:
    """A search's whole layers. ``sizes[d]`` is exact for every d; ``frames`` holds the layers that were retained."""

    spec: GraphSpec
    spark: SparkSession
    bits: int | None
    sizes: list[int] = field(default_factory=list)
    frames: dict[int, DataFrame | np.ndarray] = field(default_factory=dict)
    status: str = "COMPLETE"
    reason: str = "FRONTIER_EXHAUSTED"
    seconds: list[float] = field(default_factory=list)

    @property
    def completed_depth(self) -> int:
        return len(self.sizes) - 1

    def num_vertices(self) -> int:
        return sum(self.sizes)

    def diameter(self) -> int:
        if self.status != "COMPLETE":
            raise RuntimeError("BFS_INCOMPLETE: only completed_depth is known")
        return self.completed_depth

    def counts(self) -> DataFrame:
        """(depth, states)."""
        return self.spark.createDataFrame(list(enumerate(self.sizes)), "depth int, states long")

    def layer(self, depth: int) -> DataFrame:
        if depth not in self.frames:
            raise KeyError(depth)
        f = _frame(self.spark, self.frames[depth])
        return f.select(S.unpack("state", len(self.spec.start), self.bits).alias("state")) if self.bits else f

    def states(self) -> DataFrame:
        """(depth, state) of all retained layers."""
        parts = [self.layer(d).select(F.lit(d).alias("depth"), "state") for d in sorted(self.frames)]
        return reduce(DataFrame.unionByName, parts)


def _frame(spark: SparkSession, layer: DataFrame | np.ndarray) -> DataFrame:
    if not isinstance(layer, np.ndarray):
        return layer
    if layer.ndim == 2:
        offsets = pa.array(np.arange(len(layer) + 1, dtype=np.int32) * layer.shape[1])
        layer = pa.ListArray.from_arrays(offsets, pa.array(layer.ravel()))
    return spark.createDataFrame(pa.table({"state": layer}))


def _local(layer: DataFrame | np.ndarray) -> np.ndarray:
    """Sorted packed states of a layer whose size the caller has checked."""
    return layer if isinstance(layer, np.ndarray) else np.sort(layer.toArrow().column("state").to_numpy())


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is several times faster here than the hash tables of np.unique."""
    v = np.sort(values, axis=None)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def _packed_step(history: list[np.ndarray], spec: GraphSpec, bits: int) -> np.ndarray:
    """The layer after the last of ``history``, sorted."""
    cur = history[-1]
    kids = np.empty((len(spec.generators), len(cur)), np.int64)
    for row, g in zip(kids, spec.generators, strict=True):
        row[:] = 0
        for d, mask in S.packed_moves(g, bits):
            row |= (cur & mask) << bits * d if d >= 0 else (cur & mask) >> -bits * d
    new = distinct(kids)
    for old in history:
        at = np.minimum(np.searchsorted(old, new), len(old) - 1)
        new = new[old[at] != new]
    return new


def _driver_lane(spark: SparkSession, spec: GraphSpec, retain: int | None, limit) -> Layers:
    """The same search in NumPy for an orbit of at most DRIVER_STATES: a cluster would only add its latency. Layers stay
    arrays until they are asked for."""
    bits = S.bits_of(spec)
    out = Layers(spec, spark, bits)
    cur = np.array([S.packed(spec.start, bits)] if bits else [spec.start], np.int64)
    seen, history, rolling = {spec.start}, [cur], spec.inverse_closed()
    while len(cur):
        out.sizes.append(len(cur))
        out.frames[out.completed_depth] = cur
        if retain is not None and len(out.frames) > retain:
            out.frames.pop(min(out.frames))
        if stop := limit(out):
            out.status, out.reason = "INCOMPLETE", stop
            break
        if bits:
            last, cur = cur, _packed_step(history, spec, bits)
            history = [last, cur] if rolling or len(history) == 1 else [distinct(np.concatenate([history[0], last])), cur]
            continue
        if spec.kind == "permutation":
            kids = np.concatenate([cur[:, list(g)] for g in spec.generators])
            kids = map(tuple, np.unique(kids, axis=0).tolist())
        else:
            kids = sorted({spec.successor(tuple(s), g) for s in cur.tolist() for g in range(len(spec.generators))})
        new = [s for s in kids if s not in seen]
        seen.update(new)
        cur = np.array(new, np.int64).reshape(-1, len(spec.start))
    return out


def layers(spark: SparkSession, spec: GraphSpec, lane: str = "auto", retain: int | None = None, maximum_states: int | None = None, max_layers: int | None = None, max_seconds: float | None = None, cancelled=lambda: False, on_layer=None) -> Layers:
    """Breadth-first layers of an orbit. Limits are looked at between layers, so every layer that is reported is whole.
    ``on_layer(depth, size, layers)`` is called for each as soon as it is whole, before the next is begun.

    lane: ``driver``, ``packed``, ``hybrid``, ``array``, or ``auto`` (driver for orbits proved small, else hybrid if
    states fit into 63 bits and inverse closure is proved, else packed if they fit, else array). The hybrid lane is the
    packed one, but that layers with at most DRIVER_CHILDREN children, which a job's latency would dominate, are stepped
    in NumPy on the driver; layers pass from one to the other as their sizes, which are known, cross that. ``retain``: how many of the last layers keep their states (all if None); the history that the search itself
    needs is kept in any case. Stops: DEADLINE, PROFILE_LAYER_LIMIT, CANCELLED. ``maximum_states`` raises ORACLE_CAPACITY.
    """
    began = time.monotonic()

    def limit(out: Layers) -> str | None:
        if on_layer is not None:
            on_layer(out.completed_depth, out.sizes[-1], out)
        if maximum_states is not None and sum(out.sizes) > maximum_states and out.completed_depth:
            raise GraphError("ORACLE_CAPACITY")
        if cancelled():
            return "CANCELLED"
        if max_seconds and time.monotonic() - began >= max_seconds:
            return "DEADLINE"
        if max_layers is not None and out.completed_depth >= max_layers:
            return "PROFILE_LAYER_LIMIT"
        return None

    if lane == "auto":
        bound = orbit_bound(spec)
        lane = "driver" if bound is not None and bound <= DRIVER_STATES else "hybrid"
    if lane == "driver":
        return _driver_lane(spark, spec, retain, limit)
    bits = S.bits_of(spec) if lane in ("packed", "hybrid") else None
    rolling = spec.inverse_closed()
    hybrid = lane == "hybrid" and bits is not None and rolling
    out = Layers(spec, spark, bits)
    kind = "bigint" if bits else "array<bigint>"
    if hybrid:
        cur = np.array([S.packed(spec.start, bits)], np.int64)
    else:
        cur = spark.createDataFrame([(S.packed(spec.start, bits) if bits else list(spec.start),)], f"state {kind}")
    n, history, held = 1, [cur], 0
    while n:
        out.sizes.append(n)
        out.frames[out.completed_depth] = cur
        held += n if isinstance(cur, np.ndarray) else 0
        if retain is not None and len(out.frames) > retain:
            gone = out.frames.pop(min(out.frames))
            if isinstance(gone, np.ndarray):
                held -= len(gone)
            elif all(gone is not h for h in history):
                discard(gone)
        if held > DRIVER_HELD:
            out.frames |= {d: materialized(_frame(spark, x), "layer")[0] for d, x in out.frames.items() if isinstance(x, np.ndarray)}
            held = 0
        if stop := limit(out):
            out.status, out.reason = "INCOMPLETE", stop
            break
        t = time.monotonic()
        if hybrid and max(out.sizes[-2:]) * len(spec.generators) <= DRIVER_CHILDREN:
            cur = _packed_step([_local(h) for h in history], spec, bits)
            n = len(cur)
        else:
            with sized(spark, n * len(spec.generators) + sum(out.sizes[-2:] if rolling else out.sizes)), wrapping(spark):
                known = [_frame(spark, h) for h in history]
                kids = known[-1].select(F.explode(S.children(spec, "state", bits)).alias("state"), F.lit(1).alias("new"))
                past = reduce(DataFrame.unionByName, known).select("state", F.lit(0).alias("new"))
                fresh = kids.unionByName(past).groupBy("state").agg(F.min("new").alias("new")).where("new = 1").select("state")
                cur, n = materialized(fresh, "layer")
        out.seconds.append(time.monotonic() - t)
        old = history[:-1] if rolling else []
        history = [history[-1], cur] if rolling else [*history, cur]
        for h in old:
            if not isinstance(h, np.ndarray) and all(h is not f for f in out.frames.values()):
                discard(h)
    return out


def layer_counts(spark: SparkSession, spec: GraphSpec, **options) -> DataFrame:
    return layers(spark, spec, **options).counts()


# explicit graphs


class Csr:
    """An edge table of whole-number vertices on the driver: places of vertices, and each one's neighbours in a row."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, others: np.ndarray) -> None:
        self.vertices = distinct(np.concatenate([src, dst, others]))
        s, t = self.place(src), self.place(dst)
        order = np.argsort(s, kind="stable")
        self.to = t[order]
        self.start = np.searchsorted(s[order], np.arange(len(self.vertices) + 1))

    def place(self, vertices: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.vertices, vertices)

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``at``, neighbour) of all their arcs."""
        n = self.start[at + 1] - self.start[at]
        who = np.repeat(np.arange(len(at)), n)
        return who, self.to[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def levels(self, at: np.ndarray, most: int | None = None) -> np.ndarray:
        """The depth of every vertex from the places ``at``; -1 if it is out of reach."""
        depth = np.full(len(self.vertices), -1, np.int32)
        depth[at], k = 0, 0
        while len(at) and (most is None or k < most):
            k += 1
            at = distinct(self.around(at)[1])
            at = at[depth[at] < 0]
            depth[at] = k
        return depth


def driver_graph(arcs: DataFrame, n: int, others: DataFrame, vertex: str = "vertex") -> Csr | None:
    """``arcs`` (n of them, counted) on the driver, if they are few and their vertices are whole numbers; else None."""
    kinds = {arcs.schema["src"].dataType, arcs.schema["dst"].dataType, others.schema[vertex].dataType}
    if n > DRIVER_ARCS or not all(k.typeName() in ("integer", "long") for k in kinds):
        return None
    t, o = arcs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").toArrow(), others.select(vertex).where(F.col(vertex).isNotNull()).limit(DRIVER_ARCS + 1).toArrow()
    if o.num_rows > DRIVER_ARCS:
        return None
    return Csr(*(c.to_numpy().astype(np.int64) for c in (t.column("src"), t.column("dst"), o.column(0))))


def vertex_frame(spark: SparkSession, g: Csr, chosen: np.ndarray, like: DataFrame, vertex: str = "dst", **columns: np.ndarray) -> DataFrame:
    """(vertex, and ``columns``) of the places ``chosen`` of a driver graph, in the type that ``like`` has for vertices."""
    table = pa.table({"vertex": pa.array(g.vertices[chosen]), **{k: pa.array(v) for k, v in columns.items()}})
    df = spark.createDataFrame(table).withColumn("vertex", F.col("vertex").cast(like.schema[vertex].dataType))
    return materialized(df, "distances")[0]


def edge_layers(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, undirected: bool = False) -> list[DataFrame]:
    """The layers (root, vertex, depth) of ``edge_distances``, each a stored table of its own."""
    arcs, _ = materialized(edges.select("src", "dst").distinct(), "arcs")
    return _cluster_layers(arcs, sources, max_depth, undirected)


def _cluster_layers(arcs: DataFrame, sources: DataFrame, max_depth: int | None, undirected: bool) -> list[DataFrame]:
    cur, n = materialized(sources.select("root", "vertex", F.lit(0).alias("depth")).distinct(), "sources")
    done, depth = [cur], 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        kids = cur.join(arcs, F.col("vertex") == F.col("src")).select("root", F.col("dst").alias("vertex"), F.lit(depth).alias("depth"))
        # along edges that go both ways a child can only be in its parent's layer or next to it
        past = reduce(DataFrame.unionByName, done[-2:] if undirected else done)
        fresh = kids.unionByName(past).groupBy("root", "vertex").agg(F.min("depth").alias("depth")).where(f"depth = {depth}")
        cur, n = materialized(fresh, "layer")
        if n:
            done.append(cur)
    return done


def edge_distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, undirected: bool = False, lane: str = "auto") -> DataFrame:
    """(root, vertex, depth): distances in an edge table (src, dst) from each source (root, vertex).

    Several sources of one root make it a multi-source search; several roots are searched at once. Duplicate sources and
    edges don't matter. Vertices may be of any type. A layer is one join on src, and one aggregation with the
    layers before it: two if the caller knows that every edge is there both ways (``undirected``), else all. Edge tables of
    at most DRIVER_ARCS distinct arcs between whole numbers, with as many results, are searched on the driver (lane
    ``auto``; ``cluster`` never does), where no layer costs a job.
    """
    arcs, n = materialized(edges.select("src", "dst").distinct(), "arcs")
    spark, sources = edges.sparkSession, sources.select("root", "vertex").distinct()
    if lane == "auto" and (g := driver_graph(arcs, n, sources)) is not None:
        t = sources.where("vertex IS NOT NULL").toArrow()
        at, code = g.place(t.column("vertex").to_numpy()), t.column("root").combine_chunks().dictionary_encode()
        if isinstance(code, pa.ChunkedArray):
            code = code.combine_chunks()
        which = code.indices.to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64)
        if len(code.dictionary) * len(g.vertices) <= 2 * DRIVER_ARCS:
            parts = []
            for r in range(len(code.dictionary)):
                depth = g.levels(at[which == r], max_depth)
                seen = np.flatnonzero(depth >= 0)
                parts.append((np.full(len(seen), r), seen, depth[seen]))
            root, seen, depth = (np.concatenate([np.zeros(0, np.int32), *(p[k] for p in parts)]).astype(np.int64 if k < 2 else np.int32) for k in range(3))
            table = pa.table({"root": code.dictionary.take(pa.array(root)), "vertex": pa.array(g.vertices[seen]), "depth": pa.array(depth)})
            df = spark.createDataFrame(table).select(F.col("root").cast(sources.schema["root"].dataType), F.col("vertex").cast(edges.schema["dst"].dataType), "depth")
            return materialized(df, "distances")[0]
    return reduce(DataFrame.unionByName, _cluster_layers(arcs, sources, max_depth, undirected))


def distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, undirected: bool = False, lane: str = "auto") -> DataFrame:
    """(vertex, depth) from a set of sources (vertex)."""
    return edge_distances(edges, sources.select(F.lit(0).alias("root"), "vertex"), max_depth, undirected, lane).select("vertex", "depth")


def reverse_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sources)


def eccentricity(edges: DataFrame, vertices: DataFrame, sources: DataFrame) -> DataFrame:
    """(covering_radius): the largest distance from the sources; null if a vertex (vertex) is out of reach."""
    reach = distances(edges, sources)
    all_, got = vertices.agg(F.countDistinct("vertex").alias("n")), reach.agg(F.count("*").alias("m"), F.max("depth").alias("r"))
    return all_.join(got).select(F.when(F.col("n") == F.col("m"), F.col("r")).alias("covering_radius"))


@dataclass
class Labeled:
    """A search with first-discovery parents: rows (state, depth, parent, parent_move, ord), and its work."""

    rows: DataFrame
    sizes: list[int]
    generated: int


def _first(frame: DataFrame, state: str = "state") -> DataFrame:
    """For each state its first discovery: least parent place, then least place among the parent's edges."""
    return frame.groupBy(state).agg(F.min(F.struct("parent_ord", "edge_ord", "parent", "move")).alias("w"))


def labeled(edges: DataFrame, sources: list, max_layers: int | None = None) -> Labeled:
    """Search of an edge table (src, ord, move, dst) from sources in order, with the parent that finds a vertex first
    when vertices are expanded in the order of their discovery and edges in the order of ``ord``.

    Places in a layer come from a range-partitioned sort, not from a window over all rows. ``generated`` counts the
    edges of all layers, the last one's included.
    """
    spark = edges.sparkSession
    kind = edges.schema["dst"].dataType.simpleString()
    arcs, _ = materialized(edges.select("src", F.col("ord").cast("int").alias("edge_ord"), F.col("move").cast("string").alias("move"), "dst"), "arcs")
    start = list(dict.fromkeys(sources))
    columns = f"state {kind}, depth int, parent {kind}, parent_move string, ord long"
    cur = spark.createDataFrame([(s, 0, None, None, i) for i, s in enumerate(start)], columns)
    done, sizes, generated, n = [cur], [], 0, len(start)
    while n:
        sizes.append(n)
        if max_layers is not None and len(sizes) > max_layers:
            break
        kids = cur.join(arcs, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), F.col("ord").alias("parent_ord"), "edge_ord", F.col("src").alias("parent"), "move")
        kids, m = materialized(kids, "children")
        generated += m
        past = reduce(DataFrame.unionByName, [d.select("state") for d in done])
        won = _first(kids).join(past, "state", "left_anti").select("state", "w.*")
        placed, n = numbered(won, ["parent_ord", "edge_ord"], "ord", "layer")
        cur = placed.select("state", F.lit(len(sizes)).alias("depth"), "parent", F.col("move").alias("parent_move"), "ord")
        if n:
            done.append(cur)
    return Labeled(reduce(DataFrame.unionByName, done), sizes, generated)


def implicit_edges(spark: SparkSession, spec: GraphSpec) -> DataFrame:
    """The edge table of an orbit: (src, ord, move, dst), states as comma-joined text."""
    found = layers(spark, spec)
    text = lambda c: F.array_join(c, ",")
    names = F.array(*map(F.lit, spec.names))
    return found.states().select(text("state").alias("src"), F.posexplode(S.children(spec)).alias("ord", "child")).select("src", "ord", names[F.col("ord")].alias("move"), text("child").alias("dst"))


def reconstruct(result: DataFrame, target) -> list[str]:
    """The moves from a source to ``target`` by its parents: one look-up per step. KeyError if it wasn't reached."""
    moves, at = [], target
    while True:
        row = result.where(F.col("state") == at).select("parent", "parent_move").first()
        if row is None:
            raise KeyError(at)
        if row.parent is None:
            return moves[::-1]
        if row.parent_move is None:
            raise ValueError("PARENT_MOVE_MISSING")
        moves.append(row.parent_move)
        at = row.parent


def replay(source, moves: list, apply):
    for m in moves:
        source = apply(source, m)
    return source


def target_search(edges: DataFrame, source, target, granularity: str = "candidate", batch: int = 1) -> dict:
    """Search that stops at a candidate, at the end of a batch of parents, or at the end of a level. Distance and path are
    the same; the counters of work are those of a search that had stopped there, from the hit's place (parent, edge)."""
    if granularity not in ("candidate", "parent_batch", "level") or batch < 1:
        raise ValueError("TARGET_STOP_GRANULARITY")
    if source == target:
        return {"found": True, "distance": 0, "moves": [], "generated_transitions": 0, "expanded_states": 0, "discovered_states": 1, "completed_levels": 0}
    spark = edges.sparkSession
    kind = edges.schema["dst"].dataType.simpleString()
    arcs, _ = materialized(edges.select("src", F.col("ord").cast("int").alias("edge_ord"), F.col("move").cast("string").alias("move"), "dst"), "arcs")
    cur = spark.createDataFrame([(source, None, None, 0)], f"state {kind}, parent {kind}, parent_move string, ord long")
    done, generated, expanded, discovered, depth, n = [cur], 0, 0, 1, 0, 1
    while n:
        kids, m = materialized(cur.join(arcs, F.col("state") == F.col("src")).select(F.col("dst").alias("state"), F.col("ord").alias("parent_ord"), "edge_ord", F.col("src").alias("parent"), "move"), "children")
        past = reduce(DataFrame.unionByName, [d.select("state") for d in done])
        won, k = materialized(_first(kids).join(past, "state", "left_anti").select("state", "w.*"), "won")
        hit = won.where(F.col("state") == target).first()
        if hit is None:
            generated, expanded, discovered = generated + m, expanded + n, discovered + k
            placed, n = numbered(won, ["parent_ord", "edge_ord"], "ord", "layer")
            cur = placed.select("state", "parent", F.col("move").alias("parent_move"), "ord")
            depth += 1
            if n:
                done.append(cur)
            continue
        p = hit.parent_ord
        last = p if granularity == "candidate" else min(n, (p // batch + 1) * batch) - 1 if granularity == "parent_batch" else n - 1
        upto = F.col("parent_ord") <= last
        if granularity == "candidate":
            upto = (F.col("parent_ord") < p) | ((F.col("parent_ord") == p) & (F.col("edge_ord") <= hit.edge_ord))
        path = reconstruct(reduce(DataFrame.unionByName, done), hit.parent)
        return {"found": True, "distance": depth + 1, "moves": [*path, hit.move], "generated_transitions": generated + kids.where(upto).count(), "expanded_states": expanded + last + 1, "discovered_states": discovered + won.where(upto).count(), "completed_levels": depth + (1 if granularity == "level" else 0)}
    return {"found": False, "distance": None, "moves": None, "generated_transitions": generated, "expanded_states": expanded, "discovered_states": discovered, "completed_levels": depth}

