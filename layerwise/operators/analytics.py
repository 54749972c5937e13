"""Structure of searched graphs, as aggregations and joins. Covers AG1-AG10, AG13, AG15-AG18, AG21-AG24, BF17-BF19, BF21, BF23, JN12."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialized
from .search import distances, driver_graph, edge_layers, vertex_frame


def layer_sizes(depths: DataFrame) -> DataFrame:
    return depths.groupBy("depth").agg(F.count("*").alias("states"))


def level_breakdown(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Per expanded depth: frontier, generated, unique_candidates, batch_duplicates, visited_hits, accepted,
    cumulative_visited. A candidate is accepted if its own depth is one more than that of its parent."""
    kids = depths.select(F.col("vertex").alias("src"), "depth").join(edges.select("src", "dst"), "src").groupBy("depth", "dst").agg(F.count("*").alias("n"))
    kids = kids.join(depths.select(F.col("vertex").alias("dst"), F.col("depth").alias("own")), "dst")
    per = kids.groupBy("depth").agg(F.sum("n").alias("generated"), F.count("*").alias("unique_candidates"), F.count_if(F.col("own") <= F.col("depth")).alias("visited_hits"), F.count_if(F.col("own") > F.col("depth")).alias("accepted"))
    out = layer_sizes(depths).withColumnRenamed("states", "frontier").join(per, "depth", "left").na.fill(0)
    before = F.sum("frontier").over(Window.orderBy("depth"))  # one row per depth
    return out.select("depth", "frontier", "generated", "unique_candidates", (F.col("generated") - F.col("unique_candidates")).alias("batch_duplicates"), "visited_hits", "accepted", (before + F.col("accepted")).alias("cumulative_visited"))


def edge_split(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Per depth: arcs to the layer before (backward), the same, one after (forward), or an older one."""
    d = depths.select(F.col("vertex").alias("dst"), F.col("depth").alias("to"))
    e = depths.select(F.col("vertex").alias("src"), "depth").join(edges.select("src", "dst"), "src").join(d, "dst")
    step = F.col("to") - F.col("depth")
    return e.groupBy("depth").agg(F.count_if(step == -1).alias("backward"), F.count_if(step == 0).alias("same"), F.count_if(step == 1).alias("forward"), F.count_if(step < -1).alias("older"))


def relation_onset(edges: DataFrame, depths: DataFrame, degree: int) -> DataFrame:
    """Per depth of the children: occurrences, returns to a parent, other visited, new occurrences, accepted, convergent
    duplicates, and the nonbacktracking words d(d-1)^(k-1) that a tree would have."""
    split = edge_split(edges, depths)
    sizes = depths.groupBy((F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("accepted"))
    out = split.join(sizes, "depth", "left").na.fill(0)
    total = F.col("backward") + F.col("same") + F.col("forward") + F.col("older")
    return out.select((F.col("depth") + 1).alias("depth"), total.alias("occurrences"), F.col("backward").alias("parent_returns"), (F.col("same") + F.col("older")).alias("visited_nonparent"), F.col("forward").alias("candidate_occurrences"), "accepted", (F.col("forward") - F.col("accepted")).alias("convergence_duplicates"), (F.lit(degree) * F.pow(F.lit(degree - 1), F.col("depth"))).cast("long").alias("nonbacktracking_words"))


def duplicate_split(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Per depth of the children: frontier_in, generated, old_visited_duplicates (occurrences of states that the layers before
    hold), same_layer_duplicates (further occurrences of new states), duplicates_total, survivors and both shares."""
    split = edge_split(edges, depths)
    sizes = layer_sizes(depths)
    after = sizes.select((F.col("depth") - 1).alias("depth"), F.col("states").alias("survivors"))
    out = sizes.join(split, "depth").join(after, "depth", "left").na.fill(0)
    old = F.col("backward") + F.col("same") + F.col("older")
    out = out.select((F.col("depth") + 1).alias("depth"), F.col("states").alias("frontier_in"), (old + F.col("forward")).alias("generated"), old.alias("old_visited_duplicates"), (F.col("forward") - F.col("survivors")).alias("same_layer_duplicates"), (old + F.col("forward") - F.col("survivors")).alias("duplicates_total"), "survivors")
    return out.withColumns({"duplicate_fraction": F.col("duplicates_total") / F.col("generated"), "survivor_fraction": F.col("survivors") / F.col("generated")})


def outward_per_new(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """(depth, outward, states, outward_per_new): arcs from each layer into the next, for each vertex of that."""
    out = edge_split(edges, depths).select((F.col("depth") + 1).alias("depth"), F.col("forward").alias("outward"))
    return layer_sizes(depths).join(out, "depth").withColumn("outward_per_new", F.col("outward") / F.col("states")).select("depth", "outward", "states", "outward_per_new")


def path_counts(edges: DataFrame, sources: DataFrame, undirected: bool = False, lane: str = "auto") -> DataFrame:
    """(vertex, depth, sigma): shortest paths from the sources (parallel edges count once), summed layer by layer. Lanes as
    those of ``edge_distances``; counts beyond 2^62 leave the driver's, and raise on the cluster."""
    arcs, n = materialized(edges.select("src", "dst").distinct(), "arcs")
    if lane == "auto" and (g := driver_graph(arcs, n, sources)) is not None:
        at = np.unique(g.place(sources.select("vertex").where("vertex IS NOT NULL").distinct().toArrow().column(0).to_numpy()))
        depth = g.levels(at)
        sigma = np.zeros(len(depth))
        exact = np.zeros(len(depth), np.int64)
        sigma[at] = exact[at] = 1
        for k in range(int(depth.max(initial=0))):
            nodes = np.flatnonzero(depth == k)
            who, to = g.around(nodes)
            down = depth[to] == k + 1
            np.add.at(sigma, to[down], sigma[nodes[who[down]]])
            np.add.at(exact, to[down], exact[nodes[who[down]]])
        if sigma.max(initial=0) < 2.0**62:
            seen = np.flatnonzero(depth >= 0)
            return vertex_frame(edges.sparkSession, g, seen, edges, depth=depth[seen], sigma=exact[seen])
    layers = [x.select("vertex", "depth") for x in edge_layers(arcs, sources.select(F.lit(0).alias("root"), "vertex"), undirected=undirected)]
    cur, _ = materialized(layers[0].select("vertex", "depth", F.lit(1).cast("long").alias("sigma")), "sigma")
    done = [cur]
    for layer in layers[1:]:
        up = cur.select(F.col("vertex").alias("src"), "sigma").join(arcs, "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum("sigma").alias("sigma"))
        cur, _ = materialized(layer.join(up, "vertex").select("vertex", "depth", "sigma"), "sigma")
        done.append(cur)
    return reduce(DataFrame.unionByName, done)


def intersection_numbers(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Per depth the least and most inward (c), same-layer (a) and outward (b) neighbours of a vertex."""
    d = depths.select(F.col("vertex").alias("dst"), F.col("depth").alias("to"))
    e = depths.select(F.col("vertex").alias("src"), "depth").join(edges.select("src", "dst").distinct(), "src", "left").join(d, "dst", "left")
    step = F.col("to") - F.col("depth")
    per = e.groupBy("src", "depth").agg(F.count_if(step == -1).alias("c"), F.count_if(step == 0).alias("a"), F.count_if(step == 1).alias("b"))
    return per.groupBy("depth").agg(*[f(x).alias(f"{n}_{x}") for x in "cab" for f, n in ((F.min, "min"), (F.max, "max"))])


def walk_counts(edges: DataFrame, sources: DataFrame, length: int) -> DataFrame:
    """(depth, occurrences): walks from the sources by length, parallel edges counted, nothing removed."""
    arcs = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    arcs, _ = materialized(arcs, "arcs")
    cur = sources.select("vertex").distinct().select("vertex", F.lit(1).cast("long").alias("n"))
    totals = []
    for k in range(length + 1):
        cur, _ = materialized(cur, "walks")
        totals.append(cur.agg(F.lit(k).alias("depth"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")))
        cur = cur.join(arcs, F.col("vertex") == F.col("src")).groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    return reduce(DataFrame.unionByName, totals)


def components(edges: DataFrame, vertices: DataFrame, lane: str = "auto") -> DataFrame:
    """(vertex, component): the least vertex of each undirected component of the arcs among ``vertices``, by hooking to the least neighbour and jumping
    over parents; about log n rounds of two aggregations with map-side minima. Lanes as those of ``edge_distances``."""
    own, n = materialized(edges.select("src", "dst").distinct(), "arcs")
    if lane == "auto" and (g := driver_graph(own, n, vertices)) is not None:
        every = np.arange(len(g.vertices))
        seen = np.isin(g.vertices, vertices.select("vertex").distinct().toArrow().column(0).to_numpy())
        low, a, b = every.copy(), np.repeat(every, np.diff(g.start)), g.to
        a, b = a[inside := seen[a] & seen[b]], b[inside]
        while True:
            old = low.copy()
            np.minimum.at(low, low[a], low[b])
            np.minimum.at(low, low[b], low[a])
            while ((up := low[low]) != low).any():
                low = up
            if (low == old).all():
                break
        at = np.flatnonzero(seen)
        return vertex_frame(edges.sparkSession, g, at, vertices, "vertex", component=g.vertices[low[at]]).withColumn("component", F.col("component").cast(vertices.schema["vertex"].dataType))
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arcs, _ = materialized(both.where("src <> dst").distinct(), "arcs")
    cur, _ = materialized(vertices.select("vertex", F.col("vertex").alias("component")).distinct(), "labels")
    while True:
        near = arcs.join(cur, F.col("src") == F.col("vertex")).groupBy("dst").agg(F.min("component").alias("low"))
        hooked = cur.join(near, F.col("vertex") == F.col("dst"), "left").select("vertex", "component", F.least("component", "low").alias("low"))
        # the least label seen by any vertex of a component's tree becomes the label of its root
        roots = hooked.groupBy("component").agg(F.min("low").alias("to")).withColumnRenamed("component", "root")
        roots, _ = materialized(roots, "roots")
        jump = roots.select(F.col("root").alias("r2"), F.col("to").alias("to2"))
        short = roots.join(jump, F.col("to") == F.col("r2"), "left").select("root", F.coalesce("to2", "to").alias("to"))
        nxt = cur.join(short, F.col("component") == F.col("root")).select("vertex", F.col("component").alias("old"), F.col("to").alias("component"))
        nxt, _ = materialized(nxt, "labels")
        moved = nxt.where("old <> component").limit(1).count()
        cur = nxt.select("vertex", "component")
        if not moved:
            return cur


def component_summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    c = components(edges, vertices).groupBy("component").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("giant_fraction"))


def strong_component(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(vertex, part): SCC of the root, what only reaches it (IN) and what only it reaches (OUT)."""
    f = distances(edges, root).select("vertex", F.lit(1).alias("f"))
    b = distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), root).select("vertex", F.lit(1).alias("b"))
    j = f.join(b, "vertex", "full")
    return j.select("vertex", F.when(F.col("f").isNotNull() & F.col("b").isNotNull(), "SCC").when(F.col("b").isNotNull(), "IN").otherwise("OUT").alias("part"))


def strong_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, component) of all strong components, by forward colouring with the least vertex and backward reach inside
    each colour; what a round settles leaves the graph."""
    left, n = materialized(vertices.select("vertex").distinct(), "left")
    arcs, _ = materialized(edges.select("src", "dst").distinct(), "arcs")
    done = []
    while n:
        colour = left.select("vertex", F.col("vertex").alias("c"))
        while True:
            low = arcs.join(colour, F.col("src") == F.col("vertex")).groupBy("dst").agg(F.min("c").alias("low"))
            nxt, _ = materialized(colour.join(low, F.col("vertex") == F.col("dst"), "left").select("vertex", F.col("c").alias("old"), F.least("c", "low").alias("c")), "colour")
            colour = nxt.select("vertex", "c")
            if not nxt.where("old <> c").limit(1).count():
                break
        inside = arcs.join(colour.select(F.col("vertex").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("vertex").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inside, _ = materialized(inside.select(F.struct(F.col("cs").alias("c"), F.col("dst").alias("v")).alias("src"), F.struct(F.col("cs").alias("c"), F.col("src").alias("v")).alias("dst")), "inside")
        roots = colour.where("vertex = c").select(F.struct("c", F.col("vertex").alias("v")).alias("vertex"))
        found, _ = materialized(distances(inside, roots).select(F.col("vertex.v").alias("vertex"), F.col("vertex.c").alias("component")), "scc")
        done.append(found)
        left, n = materialized(left.join(found, "vertex", "left_anti"), "left")
        arcs, _ = materialized(arcs.join(left.withColumnRenamed("vertex", "src"), "src", "left_semi").join(left.withColumnRenamed("vertex", "dst"), "dst", "left_semi"), "arcs")
    return reduce(DataFrame.unionByName, done)


def secondary_cost(edges: DataFrame, sources: DataFrame, undirected: bool = False) -> DataFrame:
    """(vertex, depth, cost): least cost among the paths with fewest edges (src, dst, cost)."""
    arcs, _ = materialized(edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")), "arcs")
    layers = edge_layers(arcs, sources.select(F.lit(0).alias("root"), "vertex"), undirected=undirected)
    cur, _ = materialized(layers[0].select("vertex", "depth", F.lit(0).cast("long").alias("cost")), "cost")
    done = [cur]
    for layer in layers[1:]:
        up = cur.select(F.col("vertex").alias("src"), F.col("cost").alias("c")).join(arcs, "src").groupBy(F.col("dst").alias("vertex")).agg(F.min(F.col("c") + F.col("cost")).alias("cost"))
        cur, _ = materialized(layer.select("vertex", "depth").join(up, "vertex").select("vertex", "depth", "cost"), "cost")
        done.append(cur)
    return reduce(DataFrame.unionByName, done)


def simple_paths(edges: DataFrame, source, target) -> DataFrame:
    """(hops, cost) of all simple paths between two vertices of a small graph (src, dst, cost): by definition as many rows as
    there are paths."""
    kind = edges.schema["src"].dataType.simpleString()
    cur, done, n = edges.sparkSession.createDataFrame([([source], 0)], f"path array<{kind}>, cost long"), [], 1
    while n:
        arcs = edges.select("src", "dst", F.col("cost").alias("step"))
        done.append(cur.where(F.element_at("path", -1) == F.lit(target)).select((F.size("path") - 1).alias("hops"), "cost"))
        on = cur.where(F.element_at("path", -1) != F.lit(target)).join(arcs, F.element_at("path", -1) == F.col("src")).where("NOT array_contains(path, dst)")
        cur, n = materialized(on.select(F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("step")).alias("cost")), "paths")
    return reduce(DataFrame.unionByName, done)


def pareto(paths: DataFrame) -> DataFrame:
    """The distinct (hops, cost) that no other has at most as many hops and as low a cost as, one of both less."""
    best = paths.groupBy("hops").agg(F.min("cost").alias("cost"))  # one row per number of hops
    fewer = F.min("cost").over(Window.orderBy("hops").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("least", fewer).where("least IS NULL OR cost < least").select("hops", "cost")


def dead_ends(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Vertices with no deeper neighbour, above the deepest layer."""
    d = depths.select(F.col("vertex").alias("dst"), F.col("depth").alias("to"))
    e = edges.select("src", "dst").join(d, "dst").groupBy("src").agg(F.max("to").alias("deepest"))
    top = depths.agg(F.max("depth").alias("top"))
    return depths.join(e, F.col("vertex") == F.col("src"), "left").join(top).where("coalesce(deepest, -1) <= depth AND depth < top").select("vertex", "depth")


def k_centres(apsp: DataFrame, k: int) -> DataFrame:
    """The exact k-center of a small graph given by all distances (root, vertex, depth): (centres, radius), least radius,
    then least centres. Sets of k vertices are by definition all looked at."""
    v = apsp.select(F.col("root").alias("c")).distinct()
    sets = v.select(F.array("c").alias("s"))
    for _ in range(k - 1):
        sets = sets.join(v, F.col("c") > F.element_at("s", -1)).select(F.concat("s", F.array("c")).alias("s"))
    near = sets.select("s", F.explode("s").alias("root")).join(apsp, "root").groupBy("s", "vertex").agg(F.min("depth").alias("d"))
    return near.groupBy("s").agg(F.max("d").alias("radius")).orderBy("radius", "s").limit(1).select(F.col("s").alias("centres"), "radius")


def farthest_first(edges: DataFrame, first, k: int) -> tuple[list, int]:
    """Greedy centres: each next is the vertex farthest from those before, the larger id of equals; and the radius."""
    spark, chosen = edges.sparkSession, [first]
    kind = edges.schema["src"].dataType.simpleString()
    while True:
        reach = distances(edges, spark.createDataFrame([(c,) for c in chosen], f"vertex {kind}"))
        far = reach.agg(F.max(F.struct("depth", "vertex")).alias("m")).first().m
        if len(chosen) >= k:
            return chosen, far.depth
        chosen.append(far.vertex)


def double_sweep(edges: DataFrame, start) -> tuple[int, int]:
    """(eccentricity of the start, that of the farthest vertex): the second is a lower bound of the diameter."""
    kind, out, at = edges.schema["src"].dataType.simpleString(), [], start
    for _ in range(2):
        far = distances(edges, edges.sparkSession.createDataFrame([(at,)], f"vertex {kind}")).agg(F.max(F.struct("depth", "vertex")).alias("m")).first().m
        out.append(far.depth)
        at = far.vertex
    return tuple(out)


FAR = 60  # beyond any distance between 7 vertices, and twice that still fits into a byte


def sweep_gaps(spark: SparkSession, vertices: int) -> DataFrame:
    """(mask, diameter, bound) of the connected graphs on so many vertices (7 at most) whose double sweep from vertex 0 stays
    below the diameter. Edge i of the pairs in order is bit i of the mask; every mask is looked at, in parallel."""
    from collections.abc import Iterator
    from itertools import combinations

    import pyarrow as pa

    if not 2 <= vertices <= 7:
        raise ValueError("SWEEP_VERTICES")
    pairs = list(combinations(range(vertices), 2))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = b.column(0).to_numpy()
            d = np.full((len(mask), vertices, vertices), FAR, np.int8)
            d[:, range(vertices), range(vertices)] = 0
            for i, (u, v) in enumerate(pairs):
                d[:, u, v] = d[:, v, u] = np.where(mask >> i & 1, 1, FAR)
            for k in range(vertices):
                d = np.minimum(d, d[:, :, k, None] + d[:, None, k, :])
            whole = (d < FAR).all((1, 2))
            mask, d = mask[whole], d[whole]
            far = vertices - 1 - d[:, 0, ::-1].argmax(1)  # of equals the larger vertex
            bound, diameter = d[np.arange(len(d)), far].max(1), d.max((1, 2))
            low = bound < diameter
            yield pa.RecordBatch.from_pydict({"mask": pa.array(mask[low]), "diameter": pa.array(diameter[low].astype(np.int32)), "bound": pa.array(bound[low].astype(np.int32))})

    return spark.range(1 << len(pairs)).mapInArrow(look, "mask long, diameter int, bound int")


def profile(depths: DataFrame, block, blocks: int) -> DataFrame:
    """(depth, block, states): a frontier's shares by block or owner (an expression on ``vertex``)."""
    return depths.groupBy("depth", block.alias("block")).agg(F.count("*").alias("states"))


def cut_fraction(edges: DataFrame, block) -> DataFrame:
    """(edges, remote, fraction) of arcs whose ends lie in different blocks; ``block`` maps a column to its block."""
    far = block(F.col("src")) != block(F.col("dst"))
    return edges.agg(F.count("*").alias("edges"), F.count_if(far).alias("remote")).withColumn("fraction", F.col("remote") / F.col("edges"))


def locality(candidates: DataFrame, lanes: int = 32, block: int = 256, word: int = 32) -> DataFrame:
    """Of candidates (pos, key), in groups of ``lanes`` (warps) and of ``block`` in a row: savings (those whose key another of
    the warp has already looked up), word_collisions (the same for words of a bitmap of keys), warps_with_equal,
    most_equal (lanes of one key in a warp), block_savings and blocks_with_equal."""
    warp = candidates.groupBy(F.floor(F.col("pos") / lanes).alias("g"), "key").agg(F.count("*").alias("n"))
    warp = warp.groupBy("g").agg((F.sum("n") - F.count("*")).alias("s"), F.max("n").alias("m"), (F.sum("n") - F.countDistinct(F.floor(F.col("key") / word))).alias("w"))
    warp = warp.agg(F.sum("s").alias("savings"), F.sum("w").alias("word_collisions"), F.count_if(F.col("s") > 0).alias("warps_with_equal"), F.max("m").alias("most_equal"))
    blocks = candidates.groupBy(F.floor(F.col("pos") / block).alias("g")).agg((F.count("*") - F.countDistinct("key")).alias("s"))
    return warp.join(blocks.agg(F.sum("s").alias("block_savings"), F.count_if(F.col("s") > 0).alias("blocks_with_equal")))


def conservation(breakdown: DataFrame) -> DataFrame:
    """Rows of a level breakdown that break generated = duplicates + visited hits + accepted (none if all is well)."""
    return breakdown.where(F.col("generated") != F.col("batch_duplicates") + F.col("visited_hits") + F.col("accepted"))


def hop_stretch(pairs: DataFrame, radius: float) -> DataFrame:
    """Of pairs (hops, distance): mean of hops * radius / distance, most hops beyond ceil(distance / radius)."""
    return pairs.where("distance > 0").agg(F.avg(F.col("hops") * radius / F.col("distance")).alias("mean_stretch"), F.max(F.col("hops") - F.ceil(F.col("distance") / radius)).alias("max_excess"))


def medians(runs: DataFrame) -> DataFrame:
    """(case, median, mad, runs) of repeated measurements (case, seconds)."""
    m = runs.groupBy("case").agg(F.median("seconds").alias("median"), F.count("*").alias("runs"))
    return runs.join(m, "case").groupBy("case").agg(F.first("median").alias("median"), F.median(F.abs(F.col("seconds") - F.col("median"))).alias("mad"), F.first("runs").alias("runs"))


def merged_layers(ranks: DataFrame) -> DataFrame:
    """(depth, states): the ranks' vectors (rank, layer_counts) added up by place."""
    return ranks.select(F.posexplode("layer_counts").alias("depth", "n")).groupBy("depth").agg(F.sum("n").alias("states"))
