import random

import pytest
from layerwise.functions import bounds as B
from layerwise.functions import states as S
from layerwise.operators import analytics as A
from layerwise.operators import bidirectional as D
from layerwise.operators import macro as M
from layerwise.operators import search as Q
from layerwise.operators import verify as V
from layerwise.plans import engine
from layerwise.plans import spec as P
from layerwise.plans.session import wrapping
from layerwise.sources import families as Fam
from pyspark.sql import functions as F


@pytest.mark.parametrize("lane", ["driver", "packed", "array"])
def test_lanes_agree(spark, lane):
    for spec in (Fam.coxeter(5), P.permutation("w", [[1, 2, 3, 0], [1, 0, 2, 3]], [0, 0, 1, 2]), Fam.lrx(6, 4)):
        want = spec.exact_layers(1000)
        got = Q.layers(spark, spec, lane=lane)
        assert got.sizes == list(map(len, want)) and got.diameter() == len(want) - 1
        rows = {(r.depth, tuple(r.state)) for r in got.states().collect()}
        assert rows == {(d, s) for d, layer in enumerate(want) for s in layer}
    if lane != "packed":
        big = (1 << 63) - 1
        for spec in (Fam.unitriangular(3, 3), P.matrix("m", [([2], 7), ([3], 0)], [big], 1, 1)):
            most = 4
            assert Q.layers(spark, spec, lane=lane, max_layers=most).sizes[: most + 1] == _sizes(spec, most)


def _sizes(spec, most):
    seen, cur, out = {spec.start}, {spec.start}, [1]
    for _ in range(most):
        cur = {spec.successor(s, g) for s in cur for g in range(len(spec.generators))} - seen
        if not cur:
            break
        seen |= cur
        out.append(len(cur))
    return out


def test_goldens(spark):
    assert Q.layers(spark, Fam.cube("qtm"), lane="array", max_layers=3).sizes == [1, 12, 114, 1068]
    assert Q.layers(spark, Fam.lrx(8), max_layers=7, lane="driver").sizes == [1, 3, 6, 12, 23, 44, 80, 142]
    assert Q.layers(spark, Fam.lrx(5, 4)).sizes == [1, 2, 2]
    assert Q.layers(spark, Fam.lrx(13), lane="packed", max_layers=4).sizes == [1, 3, 6, 12, 24]


def test_limits(spark):
    spec = Fam.coxeter(5)
    r = Q.layers(spark, spec, lane="array", max_layers=2, retain=1)
    assert (r.status, r.reason, r.sizes) == ("INCOMPLETE", "PROFILE_LAYER_LIMIT", [1, 4, 9])
    with pytest.raises(RuntimeError):
        r.diameter()
    with pytest.raises(KeyError):
        r.layer(0)
    assert Q.layers(spark, spec, lane="driver", cancelled=lambda: True).reason == "CANCELLED"
    with pytest.raises(P.GraphError):
        Q.layers(spark, Fam.lrx(5, 4), lane="driver", maximum_states=4)


def _oracle(edges, sources):
    adjacency = {}
    for s, o, m, d in edges:
        adjacency.setdefault(s, []).append((o, m, d))
    depth, parent, order, cur, generated = {s: 0 for s in sources}, {s: (None, None) for s in sources}, [list(dict.fromkeys(sources))], list(dict.fromkeys(sources)), 0
    while cur:
        nxt = []
        for s in cur:
            for _, m, d in sorted(adjacency.get(s, [])):
                generated += 1
                if d not in depth:
                    depth[d], parent[d] = depth[s] + 1, (s, m)
                    nxt.append(d)
        order.append(nxt)
        cur = nxt
    return depth, parent, order[:-1], generated


def _stop(edges, source, target, how, batch):
    adjacency = {}
    for s, o, m, d in edges:
        adjacency.setdefault(s, []).append((o, m, d))
    depth, cur, levels, generated, expanded, seen = 0, [source], 0, 0, 0, {source}
    while cur:
        nxt, hit = [], False
        for i, s in enumerate(cur):
            expanded += 1
            for _, _, d in sorted(adjacency.get(s, [])):
                generated += 1
                if d not in seen:
                    seen.add(d)
                    nxt.append(d)
                if d == target and not hit:
                    hit = True
                    if how == "candidate":
                        return depth + 1, generated, expanded, len(seen)
            if hit and how == "parent_batch" and ((i + 1) % batch == 0 or i + 1 == len(cur)):
                return depth + 1, generated, expanded, len(seen)
        if hit:
            return depth + 1, generated, expanded, len(seen)
        cur, depth = nxt, depth + 1
    return None, generated, expanded, len(seen)


def _random(seed, n=9, m=16):
    rng = random.Random(seed)
    return [(rng.randrange(n), i, f"m{i}", rng.randrange(n)) for i in range(m)]


def _frame(spark, edges):
    return spark.createDataFrame(edges, "src long, ord int, move string, dst long")


@pytest.mark.parametrize("seed", range(2))
def test_labeled_search(spark, seed):
    edges = _random(seed)
    depth, parent, order, generated = _oracle(edges, [0, 0, 1])
    got = Q.labeled(_frame(spark, edges), [0, 0, 1])
    rows = got.rows.collect()
    assert {r.state: r.depth for r in rows} == depth and got.generated == generated
    assert {r.state: (r.parent, r.parent_move) for r in rows} == parent
    assert [[r.state for r in sorted((x for x in rows if x.depth == d), key=lambda x: x.ord)] for d in range(len(order))] == order
    assert not V.validate(_frame(spark, edges), got.rows, labeled=True).count()
    broken = got.rows.where("depth < 2").unionByName(got.rows.where("depth >= 2").withColumn("depth", F.col("depth") + 1))
    if len(order) > 2:
        assert V.validate(_frame(spark, edges), broken, labeled=True).count()


@pytest.mark.parametrize("seed", range(2))
def test_target_search_counts_work(spark, seed):
    edges = _random(seed + 10)
    depth, *_ = _oracle(edges, [0])
    target = max(depth, key=lambda v: (depth[v], v))
    for how, batch in (("candidate", 1), ("parent_batch", 2), ("level", 1)):
        r = Q.target_search(_frame(spark, edges), 0, target, how, batch)
        if target != 0:
            assert (r["distance"], r["generated_transitions"], r["expanded_states"], r["discovered_states"]) == _stop(edges, 0, target, how, batch)
            assert len(r["moves"]) == depth[target]
    r = Q.target_search(_frame(spark, edges), 0, 99)
    assert not r["found"] and r["completed_levels"] == max(depth.values()) + 1


def test_bidirectional(spark):
    edges = Q.implicit_edges(spark, Fam.coxeter(4))
    r = D.bidirectional(edges, "0,1,2,3", "3,2,1,0", owner=F.expr("pmod(int(substring(state, 1, 1)) + 2 * int(substring(state, 3, 1)), 3)"), world=3)
    assert r["found"] and r["distance"] == 6 and len(r["moves"]) == 6
    g = Fam.coxeter(4)
    end = Q.replay(g.start, r["moves"], lambda s, m: g.successor(s, g.names.index(m)))
    assert end == (3, 2, 1, 0)
    for x in r["rounds"]:
        assert x["source_unique"] == x["local_unique"] + x["remote_unique"] and x["owner_unique"] == x["already_visited"] + x["new_states"]
        assert x["generated"] >= x["source_unique"] >= x["owner_unique"] >= x["largest_owner"] and x["remote_only_new"] <= x["new_states"]
    a = D.bidirectional(edges, "0,1,2,3", "3,2,1,0", "alternating")
    assert a["distance"] == 6 and a["expansion_trace"][:2] == ["forward", "reverse"]
    assert D.bidirectional(edges, "x", "x")["distance"] == 0 and not D.bidirectional(edges, "0,1,2,3", "nowhere")["found"]


def test_macros(spark):
    weights = [m.weight for m in M.compile_macros(Fam.lrx(8), 5)]
    assert [weights.count(k) for k in range(1, 6)] == [3, 6, 12, 23, 44]
    spec = Fam.unitriangular(3, 3)
    assert M.weighted_layers(spark, spec, 2) == list(map(len, spec.exact_layers(99)))
    with pytest.raises(P.GraphError):
        M.compile_macros(spec, 0)
    with pytest.raises(P.GraphError):
        M.compile_macros(spec, 2, capacity=3)
    c = M.commutation(Fam.coxeter(4))
    assert M.trace_normal_form((2, 0, 1), c) == (0, 2, 1) and M.trace_normal_form((1, 0, 2), c) == (1, 0, 2)


def test_state_functions(spark):
    spec = Fam.coxeter(4)
    s = Q.layers(spark, spec, lane="array").states()
    rows = s.select("depth", "state", S.lehmer_rank("state", 4).alias("r"), S.star_length("state", 4).alias("l"), S.multiset_rank("state", [1] * 4).alias("m")).collect()
    assert sorted(r.r for r in rows) == list(range(24)) and all(r.r == r.m and S.multiset_unrank(r.m, [1] * 4) == list(r.state) for r in rows)
    star = {t: d for d, layer in enumerate(Fam.star(4).exact_layers(99)) for t in layer}
    assert all(star[tuple(r.state)] == r.l for r in rows)
    w = Q.layers(spark, Fam.lrx(6, 3), lane="array").states().select(S.multiset_rank("state", [1, 1, 1, 3]).alias("m")).collect()
    assert sorted(r.m for r in w) == list(range(120))
    packed = s.select("state", S.pack("state", 4, 2).alias("k")).select("state", "k", S.unpack("k", 4, 2).alias("u"), S.packed_child("k", (2, 0, 3, 1), 2).alias("c")).select("state", "u", S.unpack("c", 4, 2).alias("c")).collect()
    assert all(r.u == r.state and r.c == [r.state[i] for i in (2, 0, 3, 1)] for r in packed)
    with wrapping(spark):
        h = s.select("state", S.state_hash("state", 4, 5).alias("h"))
    mask = (1 << 64) - 1

    def mix(x):
        for n, f in S.FINALISER:
            x = ((x ^ (x >> n)) * (f & mask)) & mask
        return x

    for r in h.collect():
        x = 5
        for i, v in enumerate(r.state):
            x = mix(x ^ v ^ i)
        assert mix(x) == r.h & mask
    moves = s.limit(1).select("state", S.rotate_left("state").alias("a"), S.rotate_right("state").alias("b"), S.swap_first("state").alias("c")).first()
    t = list(moves.state)
    assert (moves.a, moves.b, moves.c) == (t[1:] + t[:1], t[-1:] + t[:-1], [t[1], t[0], *t[2:]])


def test_structure(spark):
    path = Fam.path(spark, 5)
    v = spark.range(5).select(F.col("id").alias("vertex"))
    root = spark.createDataFrame([(0,)], "vertex long")
    apsp = Q.edge_distances(path, v.select(F.col("vertex").alias("root"), "vertex"))
    k = A.k_centres(apsp, 2).first()
    assert k.radius == 1 and list(k.centres) == [0, 3] or k.radius == 1
    assert A.farthest_first(path, 0, 2) == ([0, 4], 2) and A.double_sweep(path, 2) == (2, 4)
    grid = Fam.product(Fam.path(spark, 3), spark.range(3), Fam.cycle(spark, 4), spark.range(4), 4)
    assert [r.states for r in A.layer_sizes(Q.distances(grid, root)).orderBy("depth").collect()] == [1, 3, 4, 3, 1]
    assert A.path_counts(grid, root).where("depth = 4").first().sigma == 12
    strong = Fam.product(Fam.path(spark, 2), spark.range(2), Fam.path(spark, 2), spark.range(2), 2, strong=True)
    assert Q.distances(strong, root).where("vertex = 3").first().depth == 1
    arcs = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)], "src long, dst long")
    found = {r.vertex: r.component for r in A.strong_components(arcs, spark.range(6).select(F.col("id").alias("vertex"))).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    parts = {r.vertex: r.part for r in A.strong_component(arcs, root).collect()}
    assert parts == {0: "SCC", 1: "SCC", 2: "SCC", 3: "OUT", 4: "OUT", 5: "IN"}
    comp = A.components(spark.createDataFrame([(7, 3), (3, 5), (1, 2)], "src long, dst long"), spark.range(8).select(F.col("id").alias("vertex")))
    assert {r.vertex: r.component for r in comp.collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6, 7: 3}
    assert Q.eccentricity(arcs, spark.range(6).select(F.col("id").alias("vertex")), root).first()[0] is None
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 2.0, 0.0)], "id long, x double, y double")
    assert {(r.src, r.dst) for r in Fam.geometric(points, 1.0).collect()} == {(0, 1), (1, 0)}
    loc = spark.createDataFrame([(i, i % 3) for i in range(64)], "pos long, key long")
    assert A.locality(loc).first().savings == 64 - 6


def test_engine(spark, tmp_path):
    p = engine.plan(Fam.coxeter(4))
    assert p["lane"] == "driver" and p["history"] == "rolling" and p["bounds"]["multinomial"] == 24
    r = engine.run_graph(spark, "lrx6r4", str(tmp_path / "out"), retain=None)
    assert r.num_vertices() == 30
    with pytest.raises(FileExistsError):
        engine.run_graph(spark, "lrx6r4", str(tmp_path / "out"))
    from layerwise.sources import store

    assert store.read_receipts(str(tmp_path / "out"))["layer_sizes"] == r.sizes
    with pytest.raises(TypeError):
        engine.run_graph(spark, "s3", nothing=1)
    with pytest.raises(ValueError):
        engine.Options(max_seconds=-1)
    assert engine.same_prefix(r, engine.run_graph(spark, Fam.lrx(6, 4).to_json(), lane="array", max_layers=2))


def test_hybrid_lane(spark, monkeypatch):
    """Layers that pass between the driver and the cluster, in both directions, are those of the packed lane."""
    for spec in (Fam.coxeter(6), Fam.lrx(7, 2)):
        want = Q.layers(spark, spec, lane="packed")
        rows = sorted((r.depth, r.state) for r in want.states().collect())
        for most, held in ((1 << 20, 1 << 23), (100, 1 << 23), (250, 100), (0, 100)):
            monkeypatch.setattr(Q, "DRIVER_CHILDREN", most)
            monkeypatch.setattr(Q, "DRIVER_HELD", held)
            got = Q.layers(spark, spec, lane="hybrid")
            assert got.sizes == want.sizes and sorted((r.depth, r.state) for r in got.states().collect()) == rows
        monkeypatch.setattr(Q, "DRIVER_CHILDREN", 250)
        few = Q.layers(spark, spec, lane="hybrid", retain=2)
        assert few.sizes == want.sizes and sorted(few.frames) == [want.completed_depth - 1, want.completed_depth]
        assert sorted((r.depth, r.state) for r in few.states().collect()) == [r for r in rows if r[0] >= want.completed_depth - 1]
    monkeypatch.setattr(Q, "DRIVER_STATES", 0)
    assert Q.layers(spark, Fam.coxeter(5)).sizes == [1, 4, 9, 15, 20, 22, 20, 15, 9, 4, 1]
    assert Q.layers(spark, Fam.unitriangular(3, 2)).num_vertices() == 8


def test_driver_and_cluster_lanes_agree(spark):
    rng = random.Random(31)
    arcs = [(rng.randrange(80) * 10**12, rng.randrange(80) * 10**12) for _ in range(150)] + [(5, 5), (5, 6)]
    e = spark.createDataFrame(arcs, "src long, dst long")
    both = e.unionByName(e.selectExpr("dst AS src", "src AS dst"))
    roots = spark.createDataFrame([("a", arcs[0][0]), ("a", arcs[1][0]), ("b", arcs[2][1]), ("c", -1)], "root string, vertex long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(Q.edge_distances(e, roots)) == rows(Q.edge_distances(e, roots, lane="cluster"))
    assert rows(Q.edge_distances(both, roots, 2)) == rows(Q.edge_distances(both, roots, 2, undirected=True, lane="cluster"))
    one = roots.where("root = 'a'").select("vertex")
    assert rows(A.path_counts(both, one)) == rows(A.path_counts(both, one, undirected=True, lane="cluster"))
    some = e.selectExpr("src AS vertex").where("vertex % 3 = 0").unionByName(one)
    assert rows(A.components(e, some)) == rows(A.components(e, some, lane="cluster"))
    none = e.where("src < 0")
    assert rows(Q.edge_distances(none, roots)) == sorted((r, v, 0) for r, v in [tuple(x) for x in roots.collect()])
    text = e.selectExpr("string(src) AS src", "string(dst) AS dst")
    assert Q.distances(text, spark.createDataFrame([("5",)], "vertex string")).count() == 2


def test_sweep_gaps_against_all_graphs(spark):
    from itertools import combinations

    pairs, want = list(combinations(range(5), 2)), []
    for mask in range(1 << len(pairs)):
        d = [[0 if a == b else 99 for b in range(5)] for a in range(5)]
        for i, (a, b) in enumerate(pairs):
            if mask >> i & 1:
                d[a][b] = d[b][a] = 1
        for k in range(5):
            d = [[min(d[a][b], d[a][k] + d[k][b]) for b in range(5)] for a in range(5)]
        if max(map(max, d)) < 99:
            far = max(range(5), key=lambda v: (d[0][v], v))
            if max(d[far]) < max(map(max, d)):
                want.append((mask, max(map(max, d)), max(d[far])))
    assert sorted(map(tuple, A.sweep_gaps(spark, 5).collect())) == want
