"""Operator 3, embedding near-dedup on a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_COSINE = 0.98
SINE = (1 - LEAST_COSINE**2) ** 0.5  # of the largest angle of a link
SAMPLE, MOST_CENTRES = 8_192, 1_024  # vectors that centres are fitted on, and centres, at most
SHARD_ROWS = 8_000  # distinct vectors of a label beyond which it is spread over centres, and for each centre
MOST_ROWS = 16_000  # of a shard that one task holds; larger shards are compared in blocks of so many
INNER_ROWS = 512  # of the overlapping clusters in a shard that are searched in full for neighbours
NEAREST, MARGIN = 3, 0.25  # clusters that a vector joins at most, each at most so much farther than the nearest; the audit counts what that costs
DEGREE, POOL, ALPHA = 16, 48, 1.2  # of robust pruning
BEAMS, QUERIES = (8, 32, 128), 256
AUDITED = 128  # vectors of a shard whose links are counted in full; the beam must find them all
STARTS = 4  # nearest medoids that a search starts from
DENSE = 256  # links of an audited vector on average beyond which a search would visit most of the shard


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced rows: the same rows give the same centres."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        order = np.argsort(of, kind="stable")
        some, first = np.unique(of[order], return_index=True)
        sums = np.add.reduceat(x[order], first)
        norms = np.linalg.norm(sums, axis=1)
        c[some[norms > 1e-12]] = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    return c


def dealt(x: np.ndarray, c: np.ndarray) -> list[list[int]]:
    """For each vector its nearest centre, then all others to which a vector that links with it may be nearest.

    If y is nearest to c1, x nearest to c, and their angle is that of a link at most, then y is so near to the plane between
    both centres: y * (c1 - c) <= sin(angle) * |c1 - c|. So all that links with x is dealt to x's nearest centre as well.
    """
    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ c.T
        home = s.argmax(1)
        near = s[np.arange(len(s)), home][:, None] - s <= SINE * apart[home] + 1e-9
        near[np.arange(len(s)), home] = False
        out += [[int(h), *np.flatnonzero(n).tolist()] for h, n in zip(home, near, strict=True)]
    return out


def overlapping(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which clusters each vector joins: rows of flags."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ c.T))
    third = np.partition(d, min(NEAREST, d.shape[1]) - 1, axis=1)[:, min(NEAREST, d.shape[1]) - 1]
    return d <= np.minimum(d.min(1) + MARGIN, third)[:, None]


def robust_pruned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a small cluster's graph. From its POOL nearest, each vector takes the nearest that is left, which then
    rules out those that are ALPHA times nearer to it than to the vector, until it has DEGREE neighbours."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    pool = np.argsort(d, axis=1, kind="stable")[:, : min(POOL, n - 1)]
    dist = np.take_along_axis(d, pool, 1)
    np.fill_diagonal(d, 0)
    left, rows, source, to = np.ones(pool.shape, bool), np.arange(n), [], []
    for _ in range(DEGREE):
        some = left.any(1)
        if not some.any():
            break
        first = left.argmax(1)  # the pool is sorted by distance
        star = pool[rows, first]
        source.append(rows[some])
        to.append(star[some])
        left &= ~(ALPHA * d[star[:, None], pool] <= dist)
        left[rows, first] = False
    return np.concatenate(source), np.concatenate(to)


class Graph:
    """The flat graph of a shard: the union of its clusters' adjacency lists, both ways, and the clusters' medoids."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.near = x, x.astype(np.float32)
        n = len(x)
        k = max(1, -(-2 * n // INNER_ROWS))
        clusters = [np.arange(n)]
        if k > 1:
            near = overlapping(x, centres(x, k))
            clusters = [np.flatnonzero(near[:, c]) for c in range(near.shape[1])]
        edges, medoids = [np.zeros(0, np.int64)], []
        for members in clusters:
            # a cluster of very many like vectors is cut in order, with half overlaps, so that the matrix stays small
            for at in range(0, max(1, len(members) - INNER_ROWS), INNER_ROWS) if len(members) > 2 * INNER_ROWS else [0]:
                some = members[at : at + 2 * INNER_ROWS]
                if len(some):
                    medoids.append(int(some[(x[some] @ x[some].mean(0)).argmax()]))
                    u, v = robust_pruned(x[some])
                    edges += [some[u] * n + some[v], some[v] * n + some[u]]
        both = np.sort(np.concatenate(edges))
        both = both[np.flatnonzero(np.diff(both, prepend=-1))]
        # the nearest of a vertex that very many others chose: hubs would make every search visit them all
        u, v = both // n, both % n
        near = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", self.near[u[i : i + (1 << 15)]], self.near[v[i : i + (1 << 15)]]) for i in range(0, len(u), 1 << 15))])
        order = np.lexsort((-near, u))
        u, v = u[order], v[order]
        kept = np.arange(len(u)) - np.searchsorted(u, u) < 2 * DEGREE
        self.start, self.to = np.searchsorted(u[kept], np.arange(n + 1)), v[kept]
        self.medoids = np.array(sorted(set(medoids)), np.int64)

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, neighbour) of all their edges."""
        n = self.start[nodes + 1] - self.start[nodes]
        who = np.repeat(np.arange(len(nodes)), n)
        return who, self.to[np.repeat(self.start[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def found(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of the links found, verified: greedy search from the nearest medoids, which expands the ``beam``
        best so far until none of them is new, and everything in range as well."""
        n, near, k = len(self.x), self.near, len(queries)
        seen, stamp = np.zeros(k * n, bool), np.empty(k * n, np.int32)
        m = np.argsort(-(near[queries] @ near[self.medoids].T), axis=1, kind="stable")[:, :STARTS]
        q, v = np.repeat(np.arange(k), m.shape[1]), self.medoids[m].ravel()
        seen[q * n + v] = True
        s = np.einsum("ij,ij->i", near[queries[q]], near[v])
        best_q, best_v, best_s, opened = q[:0], v[:0], s[:0], np.zeros(0, bool)
        out = [np.zeros(0, np.int64)]
        while True:
            hit = s >= LEAST_COSINE - 1e-4  # single precision, to be verified
            out.append(q[hit] * n + v[hit])
            best_q, best_v, best_s = np.concatenate([best_q, q]), np.concatenate([best_v, v]), np.concatenate([best_s, s])
            opened = np.concatenate([opened, np.zeros(len(q), bool)])
            order = np.lexsort((-best_s, best_q))
            best_q, best_v, best_s, opened = best_q[order], best_v[order], best_s[order], opened[order]
            rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            keep = (rank < beam) | (~opened & (best_s >= LEAST_COSINE - 1e-4))
            best_q, best_v, best_s, opened = best_q[keep], best_v[keep], best_s[keep], opened[keep]
            if opened.all():
                break
            at, to = self.around(best_v[~opened])
            code = best_q[~opened][at] * n + to
            opened[:] = True
            code = code[~seen[code]]
            stamp[code] = np.arange(len(code), dtype=np.int32)  # of equal codes the last one stays
            code = code[stamp[code] == np.arange(len(code))]
            seen[code] = True
            q, v = code // n, code % n
            s = np.empty(len(code), np.float32)
            for i in range(0, len(code), 1 << 15):
                s[i : i + (1 << 15)] = np.einsum("ij,ij->i", near[queries[q[i : i + (1 << 15)]]], near[v[i : i + (1 << 15)]])
        code = np.concatenate(out)
        a, b = queries[code // n], code % n
        fine = a != b
        a, b = a[fine], b[fine]
        right = [np.einsum("ij,ij->i", self.x[a[i : i + (1 << 15)]], self.x[b[i : i + (1 << 15)]]) >= LEAST_COSINE for i in range(0, len(a), 1 << 15)]
        right = np.concatenate([np.zeros(0, bool), *right])
        return a[right], b[right]

    def beam(self, queries: np.ndarray) -> int | None:
        """The beam that finds all links of AUDITED vectors, half of them such as have a link among their neighbours; None if
        none does or the vectors are dense, so that blocks do better."""
        n, x = len(self.x), self.x
        who = np.repeat(np.arange(n), np.diff(self.start))
        linked = np.zeros(n, bool)
        for i in range(0, len(who), 1 << 16):
            u, v = who[i : i + (1 << 16)], self.to[i : i + (1 << 16)]
            linked[u[np.einsum("ij,ij->i", x[u], x[v]) >= LEAST_COSINE]] = True
        some = queries[linked[queries]]
        audit = np.unique(np.concatenate([q[np.linspace(0, len(q) - 1, min(len(q), AUDITED // 2)).astype(int)] for q in (queries, some) if len(q)]))
        exact = x[audit] @ x.T >= LEAST_COSINE + 1e-12
        exact[np.arange(len(audit)), audit] = False
        if exact.sum() > DENSE * len(audit):
            return None
        for beam in BEAMS:
            a, _ = self.found(audit, beam)
            if len(a) == exact.sum():
                return beam
        return None


class Forest:
    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while (up := self.parent[r]).tobytes() != r.tobytes():
            r = up
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            u, v = self.root(a), self.root(b)
            apart = u != v
            a, b, u, v = a[apart], b[apart], u[apart], v[apart]
            np.minimum.at(self.parent, np.maximum(u, v), np.minimum(u, v))


def linked(x: np.ndarray, node: np.ndarray, copies: np.ndarray, query: np.ndarray, target: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(copies that each row of ``query`` links with, root of each row), links being those of a query and a target with
    another node. Links are counted and joined as they are found and never kept, so memory grows with the rows only."""
    n, forest, counts = len(x), Forest(len(x)), np.zeros(len(x), np.int64)
    queries, targets = np.flatnonzero(query), np.flatnonzero(target)
    graph = None if exact or not len(queries) else Graph(x)
    beam = graph.beam(queries) if graph else None
    if beam:
        for i in range(0, len(queries), QUERIES):
            a, b = graph.found(queries[i : i + QUERIES], beam)
            np.add.at(counts, a, copies[b])
            forest.join(a, b)
        return counts, forest.root(np.arange(n))
    y, own = x[targets], copies[targets]
    for i in range(0, len(queries), 128):
        q = queries[i : i + 128]
        link = x[q] @ y.T >= LEAST_COSINE
        link &= node[q][:, None] != node[targets]
        counts[q] = link @ own
        top, of = forest.root(targets), forest.root(q)
        # a row whose links are all in its own tree already has nothing to join
        mixed = np.flatnonzero((link & (top != of[:, None])).any(1))
        for r in mixed.tolist():
            b = targets[link[r]]
            forest.join(np.full(len(b), q[r]), b)
    return counts, forest.root(np.arange(n))


def _shard(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, links, root) of a shard, or of a block of queries against a block of targets of a large one."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    if not t.num_rows:
        return
    node, copies, query, target = (t.column(c).to_numpy() for c in ("node", "copies", "query", "target"))
    x = _unit(t.column("embedding").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1))
    order = np.argsort(node, kind="stable")
    node, copies, query, target, x = node[order], copies[order], query[order], target[order], x[order]
    links, root = linked(x, node, copies, query, target, bool(t.column("blocks")[0].as_py() > 1))
    root = node[root]
    some = (links > 0) | (root != node)
    yield pa.RecordBatch.from_pydict({"node": pa.array(node[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared when labels are equal and not null and lengths are equal. Null vectors, those that are zero or
    hold a null or a component that isn't finite, and rows without an id link with nothing. Rows with the same label
    and vector are one node of the graph with a number of copies; n_links counts all other rows that link directly.
    Rows of one id but different vectors are joined by that id. Other columns are not read.

    A label with more than SHARD_ROWS distinct vectors is spread over centres, fitted on at most SAMPLE vectors, so that
    the shards overlap and every link of a vector lies in the shard of its nearest centre. In each shard a graph is
    built on overlapping clusters and searched for the vectors that have their nearest centre there; an audit against
    full counts chooses the beam, and links are verified in double precision. Shards beyond MOST_ROWS, and those too
    dense for a search, are compared in blocks instead, without loss.
    """
    spark = vectors.sparkSession
    good = "label IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(embedding, v -> v <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    nodes = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = common.stored(nodes, "vectors").withColumn("dims", F.size("embedding"))
    sizes = common.stored(nodes.groupBy("label", "dims").agg(F.count("*").alias("n")), "labels")  # Spark broadcasts it only while it is small
    most = {r.dims: r.n for r in sizes.groupBy("dims").agg(F.max("n").alias("n")).where(F.col("n") > SHARD_ROWS).collect()}  # one row per length
    per_dims = {}
    for dims, n in most.items():
        sample = nodes.where(F.col("dims") == dims).select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
        per_dims[dims] = centres(_unit(np.array(sample.column("embedding").to_pylist())), min(MOST_CENTRES, -(-n // SHARD_ROWS)))
    shared = spark.sparkContext.broadcast(per_dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [[0]] * b.num_rows
            dims = b.column("dims").to_numpy() * (b.column("n").to_numpy() > SHARD_ROWS)
            for d in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == d)
                x = _unit(np.array(b.column("embedding").take(pa.array(at)).to_pylist()))
                for i, row in zip(at.tolist(), dealt(x, shared.value[d]), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], names=[*b.schema.names, "near"])

    columns = "label string, embedding array<double>, node long, copies long, dims int, n long"
    placed = nodes.join(sizes, ["label", "dims"]).select("label", "embedding", "node", "copies", "dims", "n").mapInArrow(assign, columns + ", near array<int>")
    key = ["label", "dims", "shard"]
    shards = placed.select("label", "embedding", "node", "copies", "dims", F.posexplode("near").alias("place", "shard"))
    shards = common.stored(shards.select("label", "embedding", "node", "copies", "dims", "shard", (F.col("place") == 0).alias("home")), "shards")
    blocks = common.stored(shards.groupBy(*key).agg(F.ceil(F.count("*") / MOST_ROWS).cast("int").alias("blocks")), "blocks")
    # of a large shard each block of vectors at home meets each block of all; a small one is one task
    role = lambda i, j, q, t: f"named_struct('i', {i}, 'j', {j}, 'query', {q}, 'target', {t})"
    asked = f"transform(sequence(0, blocks - 1), k -> {role('block', 'k', 'true', 'false')})"
    meets = f"transform(sequence(0, blocks - 1), k -> {role('k', 'block', 'false', 'true')})"
    roles = f"CASE WHEN blocks = 1 THEN array({role('0', '0', 'home', 'true')}) WHEN home THEN concat({asked}, {meets}) ELSE {meets} END"
    cut = shards.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = cut.select("node", "copies", "embedding", *key, "blocks", F.explode(F.expr(roles)).alias("r")).select("node", "copies", "embedding", *key, "blocks", "r.*")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # small rows, much work: not to be coalesced
    found = tasks.repartition(parts, *key, "i", "j").groupBy(*key, "i", "j").applyInArrow(_shard, "node long, links long, root long")
    found = common.stored(found, "links")
    joined = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = nodes.select("label", "embedding", "node", "copies").join(counts, "node", "left").join(joined, "node", "left")
    of = of.select(F.col("label").alias("__label"), F.col("embedding").alias("__vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    same = F.col("good") & (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__vector"))
    out = rows.where("good").join(of, same).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label by their cosine, and least labels handed on until nothing changes.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {LEAST_COSINE}),
r(vec_id, low) USING KEY (vec_id) AS (SELECT vec_id, vec_id FROM v UNION
  SELECT s.b, s.low FROM (SELECT e.b, min(r.low) AS low FROM r JOIN e ON e.a = r.vec_id GROUP BY e.b) s JOIN recurring.r k ON k.vec_id = s.b WHERE s.low < k.low),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.vec_id, coalesce(n.n, 0) AS n_links, r.low AS component_id, r.vec_id = r.low AS kept FROM r LEFT JOIN n ON n.a = r.vec_id
"""
