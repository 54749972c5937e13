"""The registered queries of the search engine and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..operators import analytics as A
from ..operators import bidirectional as B
from ..operators import macro as M
from ..operators import search as Q
from ..operators import verify as V
from ..sources import families as Fam
from ..sources import samples, store
from .session import wrapping
from .spec import GraphSpec

Query = Callable[[SparkSession, str], DataFrame]
Pair = tuple[Query, str]

# implicit families


def _array(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _orbit(spec: GraphSpec, most: int | None = None) -> str:
    """SQL of an orbit r(st, d): a recursive relation keyed by state."""
    stop = f" AND r.d < {most}" if most is not None else ""
    if spec.kind == "permutation":
        rows = ", ".join(f"({_array(g)})" for g in spec.generators)
        child = "list_transform(g.p, lambda i: r.st[i + 1])"
        head = f"g(p) AS (VALUES {rows})"
    else:
        n, m = spec.rows, spec.cols
        rows = ", ".join(f"({_array(f)}, {q})" for f, q in spec.generators)
        cells = ", ".join("(" + " + ".join(f"g.m[{r * n + k + 1}] * r.st[{k * m + c + 1}]" for k in range(n)) + ") % g.q" for r in range(n) for c in range(m))
        child = f"[{cells}]"
        head = f"g(m, q) AS (VALUES {rows})"
    return f"""WITH RECURSIVE {head},
r(st, d) USING KEY (st) AS (
  SELECT {_array(spec.start)}, 0
  UNION
  SELECT c.st, c.d FROM (SELECT DISTINCT {child} st, r.d + 1 d FROM r, g WHERE true{stop}) c
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.st = c.st))
"""


_COUNTS = "SELECT CAST(d AS INTEGER) AS depth, count(*) AS states FROM r GROUP BY d"


def _family(spec: GraphSpec, lane: str, most: int | None = None) -> Pair:
    def run(spark: SparkSession, _: str) -> DataFrame:
        return Q.layers(spark, spec, lane=lane, max_layers=most).counts()

    return run, _orbit(spec, most) + _COUNTS


def _families() -> dict[str, Pair]:
    out = {
        "bf8_exact_layers_s5": _family(Fam.coxeter(5), "packed"),
        "bf8_exact_layers_s7_driver": _family(Fam.coxeter(7), "driver"),
        "src8_lrx_6_2": _family(Fam.lrx(6, 2), "packed"),
        "src9_unitriangular_u3m4": _family(Fam.unitriangular(3, 4), "array"),
        "src10_pancake_6": _family(Fam.pancake(6), "packed"),
        "src11_star_6": _family(Fam.star(6), "packed"),
        "src12_transpositions_5": _family(Fam.transpositions(5), "array"),
        "src19_cube_qtm_3_layers": _family(Fam.cube("qtm"), "array", 3),
        "src21_torus_8x8": _family(Fam.cyclic([8, 8]), "array"),
    }

    def states(spark: SparkSession, _: str) -> DataFrame:
        s = Q.layers(spark, Fam.coxeter(4), lane="array").states()
        return s.select("depth", F.array_join("state", ",").alias("state"), S.lehmer_rank("state", 4).alias("lehmer"), S.inversions("state", 4).cast("int").alias("inversions"), S.cycle_count("state", 4).cast("int").alias("cycles"))

    rank = " + ".join(f"({' + '.join(f'CAST(st[{j + 1}] < st[{i + 1}] AS INTEGER)' for j in range(i + 1, 4)) or '0'}) * {(6, 2, 1, 1)[i]}" for i in range(4))
    inv = " + ".join(f"CAST(st[{i}] > st[{j}] AS INTEGER)" for i in range(1, 5) for j in range(i + 1, 5))
    at = lambda e: f"st[{e} + 1]"
    least = lambda i: f"CAST(least({i}, {at(i)}, {at(at(i))}, {at(at(at(i)))}) = {i} AS INTEGER)"
    out["pr13_pr27_state_functions_s4"] = (states, _orbit(Fam.coxeter(4)) + f"SELECT CAST(d AS INTEGER) AS depth, array_to_string(st, ',') AS state, CAST({rank} AS BIGINT) AS lehmer, CAST({inv} AS INTEGER) AS inversions, CAST({' + '.join(least(i) for i in range(4))} AS INTEGER) AS cycles FROM r")
    return out


# explicit families

_EXPLICIT = {
    "src13_hamming_3_3": (lambda s: Fam.hamming(s, 3, 3), "SELECT a.i AS src, b.i AS dst FROM range(27) a(i), range(27) b(i) WHERE CAST(a.i % 3 <> b.i % 3 AS INTEGER) + CAST(a.i // 3 % 3 <> b.i // 3 % 3 AS INTEGER) + CAST(a.i // 9 <> b.i // 9 AS INTEGER) = 1", 0),
    "src14_johnson_6_3": (lambda s: Fam.johnson(s, 6, 3), "SELECT a.i AS src, b.i AS dst FROM range(64) a(i), range(64) b(i) WHERE bit_count(a.i) = 3 AND bit_count(b.i) = 3 AND bit_count(xor(a.i, b.i)) = 2", 7),
    "src17_lamplighter_4": (lambda s: Fam.lamplighter(s, 4), "SELECT i AS src, xor(i // 4, 1 << CAST(i % 4 AS INTEGER)) * 4 + i % 4 AS dst FROM range(64) t(i) UNION ALL SELECT i, i // 4 * 4 + (i + 1) % 4 FROM range(64) t(i) UNION ALL SELECT i, i // 4 * 4 + (i + 3) % 4 FROM range(64) t(i)", 0),
    "src18_de_bruijn_2_5": (lambda s: Fam.de_bruijn(s, 2, 5), "SELECT i AS src, (i * 2 + c) % 32 AS dst FROM range(32) t(i), range(2) u(c)", 0),
    "src22_grid_4_5": (lambda s: Fam.product(Fam.path(s, 4), s.range(4), Fam.cycle(s, 5), s.range(5), 5), "SELECT a.i * 5 + b.i AS src, c.i * 5 + d.i AS dst FROM range(4) a(i), range(5) b(i), range(4) c(i), range(5) d(i) WHERE (b.i = d.i AND abs(a.i - c.i) = 1) OR (a.i = c.i AND (b.i - d.i + 5) % 5 IN (1, 4))", 0),
}

#: Distances from a root in an edge relation e(src, dst), as d(vertex, depth).
_DISTANCES = """, r(vertex, depth) USING KEY (vertex) AS (
  SELECT {root}, 0
  UNION
  SELECT c.v, c.k FROM (SELECT DISTINCT e.dst v, r.depth + 1 k FROM r JOIN e ON e.src = r.vertex) c
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.vertex = c.v))
"""


def _with(edges: str, root: str) -> str:
    return f"WITH RECURSIVE e AS ({edges})" + _DISTANCES.format(root=root)


def _explicit() -> dict[str, Pair]:
    out = {}
    for name, (build, sql, root) in _EXPLICIT.items():

        def run(spark: SparkSession, _: str, build=build, root=root) -> DataFrame:
            return A.layer_sizes(Q.distances(build(spark), spark.createDataFrame([(root,)], "vertex long")))

        out[name] = (run, _with(sql, f"CAST({root} AS BIGINT)") + "SELECT CAST(depth AS INTEGER) AS depth, count(*) AS states FROM r GROUP BY depth")
    return out


# graphs of the driver's tables


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Vertices are kind * 10^12 + key: region 0, nation 1, customer 2, order 3, part 4.
_KEYS = (("nation", "n_regionkey", 0, "n_nationkey", 1), ("customer", "c_nationkey", 1, "c_custkey", 2), ("orders", "o_custkey", 2, "o_orderkey", 3), ("lineitem", "l_orderkey", 3, "l_partkey", 4))
_K = 10**12


def key_graph(spark: SparkSession, sf: str, tables: int = 4) -> DataFrame:
    """The undirected graph of foreign keys, region to part."""
    parts = None
    for table, a, ka, b, kb in _KEYS[:tables]:
        p = _t(spark, sf, table).select((F.col(a).cast("long") + ka * _K).alias("src"), (F.col(b).cast("long") + kb * _K).alias("dst"))
        parts = p if parts is None else parts.unionByName(p)
    return Fam.both_ways(parts).distinct()


def _key_sql(tables: int = 4) -> str:
    one = " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) + {ka * _K} AS a, CAST({b} AS BIGINT) + {kb * _K} AS b FROM {t}" for t, a, ka, b, kb in _KEYS[:tables])
    return f"SELECT a AS src, b AS dst FROM ({one}) UNION SELECT b, a FROM ({one})"


def event_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Directed: from a user's event of one type to the next event's type, as arcs between type names, with multiplicity."""
    from pyspark.sql import Window

    e = _t(spark, sf, "events").select("user_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    return e.where("next IS NOT NULL").select(F.col("event_type").alias("src"), F.col("next").alias("dst"))


_EVENT_SQL = "SELECT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM events) WHERE nxt IS NOT NULL"


def _root(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0,)], "vertex long")


def _tables() -> dict[str, Pair]:
    keyed = _with(_key_sql(), "CAST(0 AS BIGINT)")
    out: dict[str, Pair] = {
        "ag1_key_graph_layers": (lambda s, d: A.layer_sizes(Q.distances(key_graph(s, d), _root(s), undirected=True)), keyed + "SELECT CAST(depth AS INTEGER) AS depth, count(*) AS states FROM r GROUP BY depth"),
        "bf1_key_graph_distances": (lambda s, d: Q.distances(key_graph(s, d), _root(s), undirected=True), keyed + "SELECT vertex, CAST(depth AS INTEGER) AS depth FROM r"),
        "ag3_level_breakdown": (
            lambda s, d: A.level_breakdown(g := key_graph(s, d), Q.distances(g, _root(s), undirected=True)),
            keyed
            + """, k AS (SELECT p.depth, e.dst, count(*) n, any_value(c.depth) own FROM r p JOIN e ON e.src = p.vertex JOIN r c ON c.vertex = e.dst GROUP BY 1, 2),
f AS (SELECT depth, count(*) frontier FROM r GROUP BY 1),
a AS (SELECT depth, sum(n) generated, count(*) uniq, count_if(own <= depth) hits, count_if(own > depth) accepted FROM k GROUP BY 1)
SELECT CAST(f.depth AS INTEGER) AS depth, frontier, CAST(generated AS BIGINT) AS generated, uniq AS unique_candidates, CAST(generated - uniq AS BIGINT) AS batch_duplicates, CAST(hits AS BIGINT) AS visited_hits, CAST(accepted AS BIGINT) AS accepted, CAST(sum(frontier) OVER (ORDER BY f.depth) + accepted AS BIGINT) AS cumulative_visited FROM f JOIN a ON a.depth = f.depth""",
        ),
        "ag5_edge_split": (
            lambda s, d: A.edge_split(g := key_graph(s, d), Q.distances(g, _root(s), undirected=True)),
            keyed + "SELECT CAST(p.depth AS INTEGER) AS depth, CAST(count_if(c.depth - p.depth = -1) AS BIGINT) AS backward, CAST(count_if(c.depth = p.depth) AS BIGINT) AS same, CAST(count_if(c.depth - p.depth = 1) AS BIGINT) AS forward, CAST(count_if(c.depth - p.depth < -1) AS BIGINT) AS older FROM r p JOIN e ON e.src = p.vertex JOIN r c ON c.vertex = e.dst GROUP BY p.depth",
        ),
        "ag7_path_counts": (
            lambda s, d: A.path_counts(key_graph(s, d), _root(s), undirected=True).groupBy("depth").agg(F.count("*").alias("vertices"), F.sum("sigma").alias("paths"), F.max("sigma").alias("most")),
            keyed
            + """, w(vertex, depth, sigma) AS (SELECT CAST(0 AS BIGINT), 0, CAST(1 AS BIGINT) UNION ALL
SELECT x.v, x.k, x.s FROM (SELECT e.dst v, w.depth + 1 k, CAST(sum(w.sigma) AS BIGINT) s FROM w JOIN e ON e.src = w.vertex JOIN r ON r.vertex = e.dst AND r.depth = w.depth + 1 GROUP BY 1, 2) x)
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS vertices, CAST(sum(sigma) AS BIGINT) AS paths, max(sigma) AS most FROM w GROUP BY depth""",
        ),
        "ag8_intersection_numbers": (
            lambda s, d: A.intersection_numbers(g := key_graph(s, d), Q.distances(g, _root(s), undirected=True)),
            keyed
            + """, n AS (SELECT p.vertex, p.depth, count_if(c.depth - p.depth = -1) c, count_if(c.depth = p.depth) a, count_if(c.depth - p.depth = 1) b FROM r p JOIN e ON e.src = p.vertex JOIN r c ON c.vertex = e.dst GROUP BY 1, 2)
SELECT CAST(depth AS INTEGER) AS depth, CAST(min(c) AS BIGINT) AS min_c, CAST(max(c) AS BIGINT) AS max_c, CAST(min(a) AS BIGINT) AS min_a, CAST(max(a) AS BIGINT) AS max_a, CAST(min(b) AS BIGINT) AS min_b, CAST(max(b) AS BIGINT) AS max_b FROM n GROUP BY depth""",
        ),
        "ag9_event_walks": (
            lambda s, d: A.walk_counts(event_graph(s, d).distinct(), event_graph(s, d).agg(F.min("src").alias("vertex")), 5),
            f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_EVENT_SQL})), w(depth, v) AS (SELECT 0, min(src) FROM e UNION ALL SELECT w.depth + 1, e.dst FROM w JOIN e ON e.src = w.v WHERE w.depth < 5) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS occurrences FROM w GROUP BY depth",
        ),
        "ag21_components": (
            lambda s, d: A.component_summary(key_graph(s, d), key_graph(s, d).select(F.col("src").alias("vertex"))).select("components", "largest"),
            f"WITH RECURSIVE e AS ({_key_sql()}), r(vertex, label) USING KEY (vertex) AS (SELECT DISTINCT src, src FROM e UNION SELECT x.v, x.l FROM (SELECT e.dst v, min(r.label) l FROM r JOIN e ON e.src = r.vertex GROUP BY 1) x JOIN recurring.r k ON k.vertex = x.v WHERE x.l < k.label), c AS (SELECT label, count(*) n FROM r GROUP BY 1) SELECT count(*) AS components, max(n) AS largest FROM c",
        ),
        "ag22_owner_profile": (
            lambda s, d: A.profile(Q.distances(key_graph(s, d), _root(s), undirected=True), F.pmod("vertex", F.lit(4)).cast("int"), 4),
            keyed + "SELECT CAST(depth AS INTEGER) AS depth, CAST(vertex % 4 AS INTEGER) AS block, count(*) AS states FROM r GROUP BY 1, 2",
        ),
        "ag23_cut_fraction": (
            lambda s, d: A.cut_fraction(key_graph(s, d), lambda c: F.pmod(c, F.lit(4))).select("edges", "remote"),
            f"SELECT count(*) AS edges, CAST(count_if(src % 4 <> dst % 4) AS BIGINT) AS remote FROM ({_key_sql()})",
        ),
        "src31_footer_rows": (
            lambda s, d: store.footers(s.createDataFrame([("orders.parquet",), ("events.parquet",)], "path string"), d, 2).select("path", "footer_rows"),
            "SELECT 'orders.parquet' AS path, count(*) AS footer_rows FROM orders UNION ALL SELECT 'events.parquet', count(*) FROM events",
        ),
        "ag19_layer_digests": (
            lambda s, d: store.layer_digests(_t(s, d, "nation").select(F.col("n_regionkey").cast("int").alias("depth"), F.lit(0).alias("rank"), F.col("n_nationkey").alias("rank_ordinal"), F.col("n_name").cast("binary").alias("state"))),
            "SELECT CAST(n_regionkey AS INTEGER) AS depth, sha256(string_agg(chr(0) || chr(0) || chr(0) || chr(0) || n_name, '' ORDER BY n_nationkey)) AS content_sha256 FROM nation GROUP BY 1",
        ),
        "bf25_publication_schedules": (
            lambda s, d: V.publication_schedules(s),
            """SELECT p AS protocol, x AS schedule, n > 0 AS published, CAST(n AS INTEGER) AS attempts, CAST(least(n, 1) AS INTEGER) AS unique_publications FROM (
SELECT p, x, CAST(position('publish' IN x) < position('stop' IN x) AS INTEGER) + CAST(p <> 'blind_drop' AS INTEGER) n FROM unnest(['blind_drop', 'helpable_descriptor', 'logged_intent']) a(p), (
SELECT a.e || ',' || b.e || ',' || c.e x FROM unnest(['stop', 'publish', 'recover']) a(e), unnest(['stop', 'publish', 'recover']) b(e), unnest(['stop', 'publish', 'recover']) c(e) WHERE a.e <> b.e AND b.e <> c.e AND a.e <> c.e))""",
        ),
        "ag13_conservation": (
            lambda s, d: A.conservation(A.level_breakdown(g := key_graph(s, d), Q.distances(g, _root(s), undirected=True)).withColumn("accepted", F.col("accepted") + F.when(F.col("depth") % 2 == 1, 1).otherwise(0))).select("depth", "generated", "accepted"),
            keyed + ", k AS (SELECT p.depth, e.dst, any_value(c.depth) AS own, count(*) AS n FROM r p JOIN e ON e.src = p.vertex JOIN r c ON c.vertex = e.dst GROUP BY 1, 2) SELECT CAST(depth AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS generated, count(*) FILTER (own > depth) + 1 AS accepted FROM k WHERE depth % 2 = 1 GROUP BY depth",
        ),
        "bf16_covering_radius": (
            lambda s, d: Q.eccentricity(g := key_graph(s, d), g.select(F.col("src").alias("vertex")), s.createDataFrame([(i,) for i in range(5)], "vertex long")),
            f"WITH RECURSIVE e AS ({_key_sql()}), r(vertex, depth) USING KEY (vertex) AS (SELECT CAST(i AS BIGINT), 0 FROM range(5) t(i) UNION SELECT c.v, c.k FROM (SELECT DISTINCT e.dst v, r.depth + 1 k FROM r JOIN e ON e.src = r.vertex) c WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.vertex = c.v)) SELECT CAST(CASE WHEN (SELECT count(*) FROM r) = (SELECT count(DISTINCT src) FROM e) THEN max(depth) END AS INTEGER) AS covering_radius FROM r",
        ),
        "bf20_event_reverse_distances": (
            lambda s, d: Q.reverse_distances(event_graph(s, d), event_graph(s, d).agg(F.max("src").alias("vertex"))),
            f"WITH RECURSIVE e AS (SELECT DISTINCT dst AS src, src AS dst FROM ({_EVENT_SQL}))" + _DISTANCES.format(root="(SELECT max(dst) FROM e)") + "SELECT vertex, CAST(depth AS INTEGER) AS depth FROM r",
        ),
        "bf22_nation_apsp": (
            lambda s, d: Q.edge_distances(g := key_graph(s, d, 1), g.select(F.col("src").alias("root"), F.col("src").alias("vertex")).distinct()).groupBy("depth").agg(F.count("*").alias("pairs")),
            f"WITH RECURSIVE e AS ({_key_sql(1)}), r(root, vertex, depth) USING KEY (root, vertex) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT c.root, c.v, c.k FROM (SELECT DISTINCT r.root, e.dst v, r.depth + 1 k FROM r JOIN e ON e.src = r.vertex) c WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.root = c.root AND k.vertex = c.v)) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS pairs FROM r GROUP BY depth",
        ),
        "bf23_dead_ends": (
            lambda s, d: A.dead_ends(g := key_graph(s, d), Q.distances(g, _root(s), undirected=True)).groupBy("depth").agg(F.count("*").alias("vertices")),
            keyed + ", m AS (SELECT p.vertex, p.depth, max(c.depth) top FROM r p JOIN e ON e.src = p.vertex JOIN r c ON c.vertex = e.dst GROUP BY 1, 2) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS vertices FROM m WHERE top <= depth AND depth < (SELECT max(depth) FROM r) GROUP BY depth",
        ),
        "so9_so10_layer_summary": (
            lambda s, d: store.layer_summary(A.layer_sizes(Q.distances(key_graph(s, d), _root(s), undirected=True))),
            keyed + ", c AS (SELECT depth, count(*) states FROM r GROUP BY 1) SELECT CAST(depth AS INTEGER) AS depth, states, CAST(sum(states) OVER (ORDER BY depth) AS BIGINT) AS cumulative, CAST(sum(states) OVER (ORDER BY depth ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS live FROM c",
        ),
        "ag11_routing_metrics": (
            lambda s, d: B.routing_metrics(_t(s, d, "lineitem").select(F.pmod("l_orderkey", F.lit(4)).alias("source"), F.pmod("l_partkey", F.lit(4)).alias("owner"), F.col("l_partkey").alias("state")), 4).select("generated", "local_unique", "locally_removed", "owner_unique", "cross_removed", "remote_payload"),
            "WITH c AS (SELECT l_orderkey % 4 s, l_partkey % 4 o, l_partkey k FROM lineitem), p AS (SELECT DISTINCT s, o, k FROM c) SELECT (SELECT count(*) FROM c) AS generated, (SELECT count(*) FROM p) AS local_unique, (SELECT count(*) FROM c) - (SELECT count(*) FROM p) AS locally_removed, (SELECT count(DISTINCT k) FROM p) AS owner_unique, (SELECT count(*) FROM p) - (SELECT count(DISTINCT k) FROM p) AS cross_removed, (SELECT count(*) FROM p WHERE s <> o) AS remote_payload",
        ),
        "ag16_medians": (
            lambda s, d: A.medians(_t(s, d, "events").select(F.col("event_type").alias("case"), F.col("value").alias("seconds"))).select("case", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "runs"),
            "WITH m AS (SELECT event_type c, median(value) x, count(*) n FROM events GROUP BY 1) SELECT c AS \"case\", round(any_value(x), 6) AS median, round(median(abs(value - x)), 6) AS mad, any_value(n) AS runs FROM events JOIN m ON c = event_type GROUP BY c",
        ),
        "bf19_event_strong_component": (
            lambda s, d: A.strong_component(event_graph(s, d), event_graph(s, d).agg(F.min("src").alias("vertex"))).groupBy("part").agg(F.count("*").alias("vertices")),
            f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_EVENT_SQL})), f(v) AS (SELECT min(src) FROM e UNION SELECT e.dst FROM f JOIN e ON e.src = f.v), b(v) AS (SELECT min(src) FROM e UNION SELECT e.src FROM b JOIN e ON e.dst = b.v) SELECT CASE WHEN f.v IS NOT NULL AND b.v IS NOT NULL THEN 'SCC' WHEN b.v IS NOT NULL THEN 'IN' ELSE 'OUT' END AS part, count(*) AS vertices FROM f FULL JOIN b ON f.v = b.v GROUP BY 1",
        ),
        "bf21_secondary_cost": (
            lambda s, d: A.secondary_cost(key_graph(s, d).withColumn("cost", F.pmod(F.col("src") + F.col("dst"), F.lit(7))), _root(s), undirected=True).groupBy("depth").agg(F.count("*").alias("vertices"), F.sum("cost").alias("cost")),
            keyed + ", w(vertex, depth, cost) AS (SELECT CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT) UNION ALL SELECT x.v, x.k, x.c FROM (SELECT e.dst v, w.depth + 1 k, min(w.cost + (e.src + e.dst) % 7) c FROM w JOIN e ON e.src = w.vertex JOIN r ON r.vertex = e.dst AND r.depth = w.depth + 1 GROUP BY 1, 2) x) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS vertices, CAST(sum(cost) AS BIGINT) AS cost FROM w GROUP BY depth",
        ),
    }
    return out


def _ordered(edges: DataFrame) -> DataFrame:
    """Arcs with a small place among those of their source, in the order of dst."""
    from pyspark.sql import Window

    return edges.select("src", "move", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("ord"))


# without SQL: rows only, held against goldens in tests


def _others() -> dict[str, Query]:
    def target(spark: SparkSession, d: str) -> DataFrame:
        e = _ordered(key_graph(spark, d, 2).withColumn("move", F.col("dst").cast("string")))
        rows = [(g, r["distance"], r["generated_transitions"], r["expanded_states"], r["discovered_states"], r["completed_levels"]) for g in ("candidate", "parent_batch", "level") for r in [Q.target_search(e, 0, 2 * _K + 7, g, 2)]]
        return spark.createDataFrame(rows, "granularity string, distance int, generated long, expanded long, discovered long, levels int")

    def both(spark: SparkSession, d: str) -> DataFrame:
        e = _ordered(key_graph(spark, d).withColumn("move", F.col("dst").cast("string")))
        rows = [(p, r["distance"], ",".join(r["moves"] or []), r["generated_transitions"], ",".join(r["expansion_trace"])) for p in ("smaller_frontier", "alternating") for r in [B.bidirectional(e, 0, 4 * _K + 7, p)]]
        return spark.createDataFrame(rows, "policy string, distance int, moves string, generated long, trace string")

    def rounds(spark: SparkSession, d: str) -> DataFrame:
        e = _ordered(key_graph(spark, d).withColumn("move", F.col("dst").cast("string")))
        r = B.bidirectional(e, 0, 4 * _K + 7, owner=F.pmod("state", F.lit(3)), world=3)["rounds"]
        return spark.createDataFrame([tuple(x.values()) for x in r], ", ".join(f"{c} {'string' if c == 'direction' else 'long'}" for c in B.ROUND))

    def sampled(spark: SparkSession, d: str) -> DataFrame:
        g = samples.random_graph(spark, 2000, 4.0, 0x9E3779B97F4A7C15 ^ 0x100000001B3)
        return A.layer_sizes(Q.distances(g, _root(spark)))

    def gaps(spark: SparkSession, d: str) -> DataFrame:
        return A.sweep_gaps(spark, 6).groupBy("diameter", "bound").agg(F.count("*").alias("graphs"), F.min("mask").alias("first"))

    return {"bf5_target_search": target, "bf6_bidirectional": both, "bf7_ag12_owner_rounds": rounds, "bf18_sweep_gaps": gaps, "src23_sampled_graph": sampled}


def _pairs() -> dict[str, Pair]:
    from . import catalog_units

    return _families() | _explicit() | _tables() | catalog_units.pairs()


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _pairs().items()} | _others()


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _pairs().items()}
