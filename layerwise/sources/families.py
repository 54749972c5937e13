"""Graph families: implicit ones as GraphSpec, explicit ones as edge DataFrames (src, dst) built by Spark expressions.

Covers SRC5-SRC26 (samples.py has the seeded ones), FL16.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import GraphError, GraphSpec, catalogued, from_cycles, inverse, matrix, permutation


def _swap(n: int, i: int, j: int) -> tuple[int, ...]:
    g = list(range(n))
    g[i], g[j] = g[j], g[i]
    return tuple(g)


@catalogued("PermutationGroups.coxeter")
def coxeter(n: int, start=None) -> GraphSpec:
    return permutation(f"coxeter{n}", [_swap(n, i, i + 1) for i in range(n - 1)], start or range(n), [f"s{i}" for i in range(n - 1)])


@catalogued("PermutationGroups.lrx")
def lrx(n: int, r: int = 1) -> GraphSpec:
    """Rotations left and right and the swap of the first two, on the word 0, 1, .., n-r, n-r, .. with the last label r times."""
    if not (n >= 2 and 1 <= r <= n):
        raise GraphError("LRX_MULTISET_SHAPE")
    left = (*range(1, n), 0)
    return permutation(f"lrx{n}r{r}", [left, inverse(left), _swap(n, 0, 1)], [min(i, n - r) for i in range(n)], ["L", "R", "X"])


def pancake(n: int) -> GraphSpec:
    return permutation(f"pancake{n}", [(*range(k - 1, -1, -1), *range(k, n)) for k in range(2, n + 1)], range(n))


def star(n: int) -> GraphSpec:
    return permutation(f"star{n}", [_swap(n, 0, i) for i in range(1, n)], range(n))


@catalogued("PermutationGroups.all_transpositions")
def transpositions(n: int) -> GraphSpec:
    return permutation(f"transpositions{n}", [_swap(n, i, j) for i, j in combinations(range(n), 2)], range(n))


def unitriangular(n: int, modulus: int) -> GraphSpec:
    """Elementary matrices with 1 or -1 next to the diagonal, on the unit matrix."""
    unit = [int(r == c) for r in range(n) for c in range(n)]
    found = []
    for i in range(n - 1):
        for v in (1, modulus - 1):
            m = unit.copy()
            m[i * n + i + 1] = v
            found.append((m, modulus))
    return matrix(f"u{n}m{modulus}", found, unit, n, n, bound=modulus ** (n * (n - 1) // 2))


def cyclic(moduli) -> GraphSpec:
    """Steps of one along each axis of a torus, as affine matrices on (coordinates, 1) per axis."""
    n = len(moduli)
    if len(set(moduli)) != 1:
        raise GraphError("GRAPH_MATRIX_MODULUS")
    found = []
    for i in range(n):
        for v in (1, moduli[0] - 1):
            m = [int(r == c) for r in range(n + 1) for c in range(n + 1)]
            m[i * (n + 1) + n] = v
            found.append((m, moduli[0]))
    return matrix("torus" + "x".join(map(str, moduli)), found, [0] * n + [1], n + 1, 1)


#: 4-cycles of the stickers moved by a quarter turn of each cube face. Stickers are numbered by face
#: (up, left, front, right, back, down), row by row.
CUBE = {
    "U": ((0, 2, 8, 6), (1, 5, 7, 3), (9, 36, 27, 18), (10, 37, 28, 19), (11, 38, 29, 20)),
    "L": ((9, 11, 17, 15), (10, 14, 16, 12), (0, 18, 45, 44), (3, 21, 48, 41), (6, 24, 51, 38)),
    "F": ((18, 20, 26, 24), (19, 23, 25, 21), (6, 27, 47, 17), (7, 30, 46, 14), (8, 33, 45, 11)),
    "R": ((27, 29, 35, 33), (28, 32, 34, 30), (20, 2, 42, 47), (23, 5, 39, 50), (26, 8, 36, 53)),
    "B": ((36, 38, 44, 42), (37, 41, 43, 39), (2, 9, 51, 35), (1, 12, 52, 32), (0, 15, 53, 29)),
    "D": ((45, 47, 53, 51), (46, 50, 52, 48), (24, 33, 42, 15), (25, 34, 43, 16), (26, 35, 44, 17)),
}


def cube(metric: str = "qtm") -> GraphSpec:
    """54 stickers; quarter turns (12 generators), or half turns as well (18)."""
    found, names = [], []
    for face, cycles in CUBE.items():
        g = from_cycles(54, cycles)
        two = tuple(g[i] for i in g)
        for name, p in ((face, g), (face + "'", inverse(g)), *([(face + "2", two)] if metric == "htm" else [])):
            found.append(p)
            names.append(name)
    return permutation(f"cube-{metric}", found, range(54), names)


def from_label(label: str) -> GraphSpec:
    """sN, uNmM and lrxNrR."""
    if m := re.fullmatch(r"s(\d+)", label):
        return coxeter(int(m[1]))
    if m := re.fullmatch(r"u(\d+)m(\d+)", label):
        return unitriangular(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"lrx(\d+)r(\d+)", label):
        return lrx(int(m[1]), int(m[2]))
    raise GraphError("LRX_MULTISET_LABEL")


def as_lrx(spec: GraphSpec) -> tuple[int, int, tuple[int, ...]] | None:
    """(n, r, labels) if a definition is an LRX word up to the names of its labels."""
    n = len(spec.start)
    if spec.kind != "permutation" or n < 2:
        return None
    labels = tuple(dict.fromkeys(spec.start))
    r = n - len(labels) + 1
    want = lrx(n, r)
    same = tuple(labels.index(v) for v in spec.start) == want.start and set(spec.generators) == set(want.generators)
    return (n, r, labels) if same else None


# explicit graphs: (src, dst), both directions where undirected


def _states(spark: SparkSession, n: int, digits: int, base: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "src")


def hamming(spark: SparkSession, d: int, q: int) -> DataFrame:
    """H(d, q): change one base-q digit. q = 2 is the hypercube."""
    s = F.col("src")
    moves = [F.expr(f"src + (pmod(int(src div {q**i}) % {q} + {k}, {q}) - int(src div {q**i}) % {q}) * {q**i}L") for i in range(d) for k in range(1, q)]
    return _states(spark, q**d, d, q).select(s, F.explode(F.array(*moves)).alias("dst"))


def johnson(spark: SparkSession, n: int, k: int) -> DataFrame:
    """J(n, k): k-subsets as bit sets; swap a member with another."""
    bits = spark.range(1 << n).where(F.bit_count("id") == k).select(F.col("id").alias("src"))
    out = [F.when(F.expr(f"(src & {1 << i}) != 0 AND (src & {1 << j}) = 0"), F.expr(f"src ^ {(1 << i) | (1 << j)}")) for i in range(n) for j in range(n) if i != j]
    return bits.select("src", F.explode(F.array_compact(F.array(*out))).alias("dst"))


def grassmann(spark: SparkSession, n: int, k: int) -> DataFrame:
    """J_2(n, k): k-subspaces of GF(2)^n as bit sets of their members, adjacent if they meet in dimension k-1.

    Spaces that meet so share a (k-1)-subspace, so the edges come from an equi-join on those and no all-pairs join.
    """
    spaces: set[tuple[int, ...]] = {(0,)}
    for _ in range(k):
        spaces = {tuple(sorted({*s, *(v ^ x for x in s)})) for s in spaces for v in range(1 << n) if v not in s}
    code = lambda s: sum(1 << x for x in s)
    rows = []
    for s in spaces:
        below = {tuple(x for x in s if not (f & x).bit_count() & 1) for f in range(1 << n)}
        rows += [(code(s), code(b)) for b in below if len(b) == len(s) // 2]
    t = spark.createDataFrame(rows, "space long, below long")
    u = t.withColumnRenamed("space", "other")
    return t.join(u, "below").where("space <> other").select(F.col("space").alias("src"), F.col("other").alias("dst")).distinct()


def hanoi(spark: SparkSession, discs: int) -> DataFrame:
    """Three pegs, base-3 digits; a labeled move between two pegs, a loop where neither top may move."""
    s = spark.range(3**discs).select(F.col("id").alias("src"))
    digit = lambda i: f"(int(src div {3**i}) % 3)"
    # discs are tried from the smallest, so the innermost test must be of the largest
    nested = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        move = "src"
        for i in reversed(range(discs)):
            move = f"CASE WHEN {digit(i)} = {a} THEN src + {(b - a) * 3**i} WHEN {digit(i)} = {b} THEN src + {(a - b) * 3**i} ELSE {move} END"
        nested.append(F.expr(f"named_struct('move', '{a}{b}', 'dst', {move})"))
    return s.select("src", F.explode(F.array(*nested)).alias("x")).select("src", "x.move", "x.dst")


def lamplighter(spark: SparkSession, n: int) -> DataFrame:
    """Lamps (bits) and a place, as lamps * n + place: toggle, step on, step back."""
    s = spark.range((1 << n) * n).select(F.col("id").alias("src"))
    lamps, at = f"(src div {n})", f"(src % {n})"
    out = [f"({lamps} ^ shiftleft(1L, int({at}))) * {n} + {at}", f"{lamps} * {n} + ({at} + 1) % {n}", f"{lamps} * {n} + ({at} + {n - 1}) % {n}"]
    return s.select("src", F.posexplode(F.array(*map(F.expr, out))).alias("move", "dst"))


def de_bruijn(spark: SparkSession, q: int, n: int) -> DataFrame:
    return spark.range(q**n).select(F.col("id").alias("src"), F.explode(F.array(*[F.expr(f"(id * {q} + {c}) % {q**n}") for c in range(q)])).alias("dst"))


def kautz(spark: SparkSession, q: int, n: int) -> DataFrame:
    """Words of n letters of q + 1, no letter twice in a row."""
    base = q + 1
    s = spark.range(base**n).select(F.col("id").alias("src"))
    for i in range(n - 1):
        s = s.where(f"(src div {base**i}) % {base} <> (src div {base ** (i + 1)}) % {base}")
    return s.select("src", F.explode(F.array(*[F.expr(f"(src * {base} + {c}) % {base**n}") for c in range(base)])).alias("dst")).where(f"src % {base} <> dst % {base}")


def path(spark: SparkSession, n: int) -> DataFrame:
    return both_ways(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    return both_ways(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def product(g: DataFrame, g_nodes: DataFrame, h: DataFrame, h_nodes: DataFrame, m: int, strong: bool = False) -> DataFrame:
    """Cartesian (or strong) product; the vertex (a, b) is a * m + b, m being the vertices of the second graph.

    The size of the result is by definition a product of both inputs, which are graphs given by hand.
    """
    along = g.crossJoin(h_nodes.select(F.col("id").alias("b"))).select((F.col("src") * m + F.col("b")).alias("src"), (F.col("dst") * m + F.col("b")).alias("dst"))
    across = h.crossJoin(g_nodes.select(F.col("id").alias("a"))).select((F.col("a") * m + F.col("src")).alias("src"), (F.col("a") * m + F.col("dst")).alias("dst"))
    out = along.unionByName(across)
    if strong:
        k = h.select(F.col("src").alias("s"), F.col("dst").alias("d"))
        out = out.unionByName(g.crossJoin(k).select((F.col("src") * m + F.col("s")).alias("src"), (F.col("dst") * m + F.col("d")).alias("dst")))
    return out.distinct()


def random_graph(spark: SparkSession, n: int, degree: float, seed: int, directed: bool = False) -> DataFrame:
    """About n * degree / 2 edges (n * degree arcs): each draw hashes its number to two ends. Linear in the edges."""
    draws = round(n * degree / (1 if directed else 2))
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    e = spark.range(draws).select(h(0).alias("src"), h(1).alias("dst")).where("src <> dst")
    return (e if directed else both_ways(e)).distinct()


def block_graph(spark: SparkSession, n: int, inside: float, across: float, seed: int) -> DataFrame:
    """Two equal blocks: ends of inner draws lie in one block, those of outer draws in different ones."""
    half = n // 2
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(half))
    side = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(2)), F.lit(2))
    inner = spark.range(round(n * inside / 2)).select((h(0) + side * half).alias("src"), (h(1) + side * half).alias("dst"))
    outer = spark.range(round(n * across / 2)).select(h(3).alias("src"), (h(4) + half).alias("dst"))
    return both_ways(inner.unionByName(outer).where("src <> dst")).distinct()


def small_world(spark: SparkSession, n: int, shortcuts: int, seed: int) -> DataFrame:
    """A ring with links to the next two, and random shortcuts."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[(F.col("id") + k) % n for k in (1, 2)])).alias("dst"))
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    extra = spark.range(shortcuts).select(h(0).alias("src"), h(1).alias("dst")).where("src <> dst")
    return both_ways(ring.unionByName(extra)).distinct()


def geometric(points: DataFrame, radius: float, torus: bool = False) -> DataFrame:
    """Pairs of points (id, x, y) at most ``radius`` apart, in the plane or on the unit torus: a join on grid cells at least
    that wide and their neighbours."""
    most = max(1, int(1 / radius))
    wide, wrap = (1 / most, lambda c: F.pmod(c, F.lit(most))) if torus else (radius, lambda c: c)
    cell = points.select("id", "x", "y", wrap(F.floor(F.col("x") / wide)).alias("cx"), wrap(F.floor(F.col("y") / wide)).alias("cy"))
    around = F.array_distinct(F.array(*[F.struct(wrap(F.col("cx") + a).alias("cx"), wrap(F.col("cy") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = cell.select("id", "x", "y", F.explode(around).alias("c")).select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "c.cx", "c.cy")

    def gap(a: str, b: str) -> Column:
        d = F.abs(F.col(a) - F.col(b))
        return F.least(d, 1 - d) if torus else d

    return cell.join(near, ["cx", "cy"]).where("id <> dst").where(F.pow(gap("x", "x2"), 2) + F.pow(gap("y", "y2"), 2) <= radius**2).select(F.col("id").alias("src"), "dst")


FAMILIES: dict[str, Callable[..., GraphSpec]] = {"coxeter": coxeter, "lrx": lrx, "pancake": pancake, "star": star, "transpositions": transpositions, "unitriangular": unitriangular, "cube": cube}


def configuration(degrees: DataFrame, seed: int) -> DataFrame:
    """The erased configuration model of (vertex, degree): half-edges in the order of a hash are paired, loops and
    repeated edges dropped. A regular graph is the case of equal degrees. No task sees all half-edges."""
    from ..plans.session import numbered

    halves = degrees.where("degree > 0").select("vertex", F.explode(F.expr("sequence(1, int(degree))")).alias("i"))
    placed, n = numbered(halves.select("vertex", "i", F.xxhash64(F.lit(seed), "vertex", "i").alias("h")), ["h", "vertex", "i"], "place", "halves")
    pairs = placed.where(F.col("place") < n - n % 2).groupBy(F.floor(F.col("place") / 2).alias("k")).agg(F.min("vertex").alias("src"), F.max("vertex").alias("dst"))
    return both_ways(pairs.where("src <> dst").select("src", "dst")).distinct()


def order(g) -> int:
    """The least number of times after which a permutation is the identity: the least common multiple of its cycles."""
    from math import lcm

    out, seen = 1, set()
    for i in range(len(g)):
        at, n = i, 0
        while at not in seen:
            seen.add(at)
            at, n = g[at], n + 1
        out = lcm(out, max(n, 1))
    return out


def from_puzzle(text: str, inverse_pairs: bool = True, orders: int | dict[str, int] | None = None) -> GraphSpec:
    """A puzzle's JSON {name, central_state, generators: {move: permutation}}: every move a bijection and, if asked, with its
    inverse among the moves and of the given order (one for all, or by move). Moves keep the document's order."""
    import json

    data = json.loads(text)
    spec = permutation(data.get("name", "puzzle"), data["generators"].values(), data["central_state"], list(data["generators"]))
    if inverse_pairs and any(inverse(g) not in spec.generators for g in spec.generators):
        raise GraphError("GRAPH_PERMUTATION_GENERATOR")
    for name, g in zip(spec.names, spec.generators, strict=True):
        want = orders.get(name) if isinstance(orders, dict) else orders
        if want is not None and order(g) != want:
            raise GraphError("PUZZLE_MOVE_ORDER")
    return spec
