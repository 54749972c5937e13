import itertools
import time

from layerwise.functions import states as S
from layerwise.operators import analytics as A
from layerwise.operators import search as Q
from layerwise.operators import verify as V
from layerwise.plans import spec as P
from layerwise.plans.session import wrapping
from layerwise.sources import families as Fam
from layerwise.sources import radius, samples
from pyspark.sql import functions as F

M = (1 << 64) - 1


def sequence(seed):
    v = max(seed, 1)
    while True:
        v ^= v << 13 & M
        v ^= v >> 7
        v ^= v << 17 & M
        yield v


def rows(df):
    return sorted((r.src, r.dst) for r in df.collect())


def pairwise(n, p, seed, directed=False):
    g, out = sequence(seed), set()
    for a in range(n):
        for b in range(0 if directed else a + 1, n):
            if a != b and (next(g) >> 11) / 2**53 < p(a, b):
                out |= {(a, b)} if directed else {(a, b), (b, a)}
    return sorted(out)


def test_sequence():
    want = list(itertools.islice(sequence(5), 3000))
    assert samples.block(5, 0)[:3000].tolist() == want and samples.block(5, 777)[:500].tolist() == want[777:1277]


def test_pairwise_graphs(spark):
    assert rows(samples.random_graph(spark, 300, 4.0, 7)) == pairwise(300, lambda a, b: 4.0 / 299, 7)
    assert rows(samples.random_graph(spark, 90, 3.0, 2, True)) == pairwise(90, lambda a, b: 3.0 / 90, 2, True)
    assert rows(samples.block_graph(spark, 101, 6.0, 1.0, 0)) == pairwise(101, lambda a, b: (6.0 if (a >= 50) == (b >= 50) else 1.0) / 101, 0)
    assert rows(samples.random_graph(spark, 1, 4.0, 7)) == []


def test_several_blocks(spark):
    edges = rows(samples.random_graph(spark, 1500, 2.0, 3))  # 1,124,250 draws, two blocks
    assert edges == pairwise(1500, lambda a, b: 2.0 / 1499, 3)


def test_small_world(spark):
    for n, k, seed in ((200, 40, 3), (9, 5, 3), (20, 0, 1)):
        g, edges = sequence(seed), {tuple(sorted((v, (v + o) % n))) for v in range(n) for o in (1, 2)}
        want = len(edges) + k
        while len(edges) < want:
            a, b = next(g) * n >> 64, next(g) * n >> 64
            if a != b:
                edges.add((min(a, b), max(a, b)))
        assert rows(samples.small_world(spark, n, k, seed)) == sorted(edges | {(b, a) for a, b in edges})


def test_geometric(spark):
    p = samples.points(spark, 150, 9)
    at = {r.id: (r.x, r.y) for r in p.collect()}
    g = sequence(9)
    assert [at[i] for i in range(150)] == [((next(g) >> 11) / 2**53, (next(g) >> 11) / 2**53) for _ in range(150)]
    for radius, torus in ((0.11, False), (0.11, True), (0.45, True)):
        def gap(a, b):
            d = abs(a - b)
            return min(d, 1 - d) if torus else d

        want = sorted((a, b) for a in at for b in at if a != b and gap(at[a][0], at[b][0]) ** 2 + gap(at[a][1], at[b][1]) ** 2 <= radius**2)
        assert rows(Fam.geometric(p, radius, torus)) == want


def test_degrees(spark, monkeypatch):
    """Links counted without pairs, against all pairs: copies, places shared and several places of an id, on tiles of several
    tasks too."""
    inf, nan = float("inf"), float("nan")
    pts = [(r.id % 130, r.x, r.y) for r in samples.points(spark, 150, 9).collect()]  # 20 ids with two places
    pts += [*pts[:30], *((200 + i, i % 5 / 10, i % 7 / 10) for i in range(60))]  # copies, and gaps of just a radius
    odd = [(300, None, 0.5), (301, nan, 0.5), (302, 0.5, inf), (None, 0.5, 0.5)]
    frame = spark.createDataFrame(pts + odd, "id long, x double, y double")
    for chunk, r, torus in ((50_000, 0.1, False), (3, 0.11, True), (3, 0.3, False), (20, 0.45, True), (50_000, 0.75, True)):
        monkeypatch.setattr(radius, "CHUNK", chunk)
        monkeypatch.setattr(radius, "GROUP_ROWS", 100)

        def gap(a, b):
            d = abs(a - b)
            return min(d, 1 - d) if torus else d

        want = [(*a, pts.count(a), sum(a[0] != b[0] and gap(a[1], b[1]) ** 2 + gap(a[2], b[2]) ** 2 <= r**2 for b in pts)) for a in set(pts)]
        assert sorted(map(tuple, radius.degrees(frame, r, torus).collect())) == sorted(want)


def test_degrees_of_many(spark):
    """All of 120,000 points lie within a radius: 14 billion arcs, of which none is listed."""
    n, began = 120_000, time.monotonic()
    got = radius.degrees(spark.range(n).selectExpr("id", "0.5 + id % 347 / 100000 AS x", "0.5 + id % 353 / 100000 AS y"), 0.04)
    assert tuple(got.agg(F.count("*"), F.min("links"), F.max("links")).first()) == (n, n - 1, n - 1)
    assert time.monotonic() - began < 120


def test_published_layers(spark):
    """2,000 vertices with mean degree 4: published layers from vertex 0, along arcs and against them."""
    sizes = lambda df: [r.states for r in A.layer_sizes(df).orderBy("depth").collect()]
    root = spark.createDataFrame([(0,)], "vertex long")
    g = samples.random_graph(spark, 2000, 4.0, 0x9E3779B97F4A7C15 ^ 0x100000001B3)
    assert sizes(Q.distances(g, root)) == [1, 8, 31, 98, 351, 765, 591, 105, 9, 1]
    d = samples.random_graph(spark, 2000, 4.0, 0xD1B54A32D192ED03 ^ 0x94D049BB133111EB, True)
    assert sizes(Q.distances(d, root)) == [1, 8, 37, 152, 483, 836, 377, 56, 4, 1]
    assert sizes(Q.reverse_distances(d, root)) == [1, 2, 8, 33, 132, 407, 754, 504, 108, 9]


def test_orbit_ranks(spark):
    g = P.permutation("o", [(1, 0, 2, 3, 4), (0, 1, 3, 2, 4), (0, 1, 2, 4, 3)], [1, 0, 5, 5, 7])
    assert [(p, s) for p, s, _ in S.position_orbits(g)] == [([0, 1], [0, 1]), ([2, 3, 4], [5, 7])]
    states = [S.orbit_unrank(r, g) for r in range(6)]
    assert sorted(states) == states and len({tuple(s) for s in states}) == 6
    df = spark.createDataFrame([(s, r) for r, s in enumerate(states)], "state array<bigint>, r long")
    assert all(x.r == x.k for x in df.select("r", S.orbit_rank("state", g).alias("k")).collect())


def test_page_map(spark):
    with wrapping(spark):
        for total, world, page in ((1000, 3, 8), (64, 4, 0), (10, 3, 16), (4096, 128, 4)):
            m = spark.range(total).select("id", S.page_map("id", total, world, page).alias("m"))
            m = m.withColumn("b", S.page_unmap("m", total, world, page)).collect()
            assert sorted(x.m for x in m) == list(range(total)) and all(x.id == x.b for x in m)


def test_lossless_and_affine_keys(spark):
    seed = bytes(range(16))
    v = int.from_bytes(seed, "big")
    with wrapping(spark):
        for n, bits in ((8, 3), (25, 5), (16, 8), (21, 6), (3, 1)):
            state = [(i * 7 + 3) % (1 << bits) for i in range(n)]
            word = sum(x << i * bits for i, x in enumerate(state))
            low, high = S.lossless_key("state", n, bits)
            df = spark.createDataFrame([(state,)], "state array<bigint>").select(low.alias("lo"), high.alias("hi"))
            a, b = S.lossless_words("lo", "hi")
            r = df.select("lo", a.alias("a"), b.alias("b")).first()
            assert (r.a & M | (r.b & M) << 64) == word and r.lo & M != word & M
        for r in spark.range(5).select("id", S.affine_key("id", seed).alias("k")).collect():
            assert r.k & M == ((r.id ^ (v ^ v << 32)) * ((v ^ v >> 64) | 1)) & M


def test_schedules(spark):
    seen = {p: sorted(r.published for r in g) for p, g in itertools.groupby(V.publication_schedules(spark).orderBy("protocol").collect(), lambda r: r.protocol)}
    assert seen["blind_drop"].count(False) == 3 and all(seen["logged_intent"]) and all(seen["helpable_descriptor"]) and len(seen) == 3
