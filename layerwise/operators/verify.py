"""Checks of results, as queries whose rows are errors. Covers FL3, FL4, FL9-FL11, FL13-FL15, BF25."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def validate(edges: DataFrame, result: DataFrame, labeled: bool = False) -> DataFrame:
    """(error, vertex) of a result (state, depth, parent[, parent_move]) over an edge table (src, dst[, move])."""
    r = result.select("state", "depth", "parent", *(["parent_move"] if labeled else []))
    arcs = edges.select("src", "dst").distinct()
    at = r.select(F.col("state").alias("src"), F.col("depth").alias("d"))
    to = r.select(F.col("state").alias("dst"), F.col("depth").alias("e"))
    say = lambda df, text, v: df.select(F.lit(text).alias("error"), F.col(v).cast("string").alias("vertex"))
    along = at.join(arcs, "src").join(to, "dst", "left")
    up = r.where("parent IS NOT NULL").join(r.select(F.col("state").alias("p"), F.col("depth").alias("pd")), F.col("parent") == F.col("p"), "left")
    out = say(r.groupBy("state").count().where("count > 1"), "vertex has several depths", "state")
    out = out.unionByName(say(along.where("e IS NULL"), "reachable child is missing", "dst"))
    out = out.unionByName(say(along.where("e > d + 1"), "edge violates the shortest distance", "dst"))
    out = out.unionByName(say(up.where("pd IS NULL OR pd <> depth - 1"), "parent has the wrong depth", "state"))
    out = out.unionByName(say(r.where("(parent IS NULL) <> (depth = 0)"), "only sources lack a parent", "state"))
    key = [F.col("parent") == F.col("src"), F.col("state") == F.col("dst")]
    kids = edges.select("src", "dst", *(["move"] if labeled else []))
    if labeled:
        key.append(F.col("parent_move") == F.col("move"))
    return out.unionByName(say(r.where("parent IS NOT NULL").join(kids, key, "left_anti"), "parent has no such edge", "state"))


def compare_layers(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Depths whose counts (depth, states) differ, null where one side lacks the depth."""
    e = expected.select("depth", F.col("states").alias("expected"))
    return found.select("depth", F.col("states").alias("found")).join(e, "depth", "full").where("NOT found <=> expected")


def verify_histograms(ranks: DataFrame, expected: list[int], n: int, world: int) -> DataFrame:
    """(depth, found, expected) where the ranks' vectors (rank, status, layer_counts) don't add up to ``expected``. The ranks
    must be 0..world-1, each complete and as deep; the expected layers are those of a whole symmetric group: 1 first, n! in
    all."""
    if not expected or any(type(x) is not int or x < 1 for x in expected):
        raise ValueError("REFERENCE_COUNTS")
    if expected[0] != 1 or sum(expected) != factorial(n):
        raise ValueError("REFERENCE_NOT_FULL_SYMMETRIC_GROUP")
    a = ranks.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.count_if(F.col("status") == "COMPLETE"), F.min(F.size("layer_counts")), F.max(F.size("layer_counts")), F.min(F.array_min("layer_counts"))).first()
    if tuple(a[:4]) != (world, world, 0, world - 1):
        raise ValueError("RANK_INVENTORY")
    if a[4] != world:
        raise ValueError("RUN_INCOMPLETE_OR_WRONG_GROUP")
    if a[5] != a[6] or a[6] != len(expected):
        raise ValueError("DEPTH_COVERAGE")
    if a[7] is None or a[7] < 0:
        raise ValueError("INVALID_COUNT")
    found = ranks.select(F.posexplode("layer_counts").alias("depth", "n")).groupBy("depth").agg(F.sum("n").alias("states"))
    return compare_layers(found, ranks.sparkSession.createDataFrame(list(enumerate(expected)), "depth int, states long"))


def compare_runs(first: dict, second: dict, spark: SparkSession) -> list[str]:
    """What differs between two runs {graph, packing, status, last_completed_layer, layers: [(depth, states)]}: names of
    fields, layer_state_counts, empty_completed_layer_table. Times don't count; equal counts aren't equal sets."""
    out = [k for k in ("graph", "packing", "status", "last_completed_layer") if first.get(k) != second.get(k)]
    a, b = (spark.createDataFrame(r["layers"], "depth int, states long") for r in (first, second))
    out += ["layer_state_counts"] if compare_layers(a, b).count() else []
    return out + ([] if first["layers"] and second["layers"] else ["empty_completed_layer_table"])


def compare_states(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(side, depth, state) of states (depth, state) in one set only, duplicates included."""
    a = found.select("depth", "state").exceptAll(expected.select("depth", "state")).select(F.lit("found").alias("side"), "*")
    return a.unionByName(expected.select("depth", "state").exceptAll(found.select("depth", "state")).select(F.lit("expected").alias("side"), "*"))


def duplicate_states(states: DataFrame) -> DataFrame:
    return states.groupBy("state").count().where("count > 1")


def roll_up(checks: DataFrame) -> DataFrame:
    """(status): FAILED before NOT_VALIDATED before VERIFIED_LAYER_COUNTS."""
    rank = F.when(F.col("status") == "FAILED", 2).when(F.col("status") == "VERIFIED_LAYER_COUNTS", 0).otherwise(1)
    return checks.agg(F.max(rank).alias("r")).select(F.when(F.col("r") == 2, "FAILED").when(F.col("r") == 0, "VERIFIED_LAYER_COUNTS").otherwise("NOT_VALIDATED").alias("status"))


#: Failures that are a shortage and no error.
RESOURCE = r"(?i)out of memory|memory limit|capacity|no space|resource_"


def classify(cases: DataFrame) -> DataFrame:
    return cases.withColumn("resource_stop", F.coalesce(F.col("reason").rlike(RESOURCE), F.lit(False)))


def pruned(cases: DataFrame) -> DataFrame:
    """Cases (n, r, reason) with ``skip``: for the same r, an n above the first that a resource stopped."""
    c = classify(cases)
    first = c.where("resource_stop").groupBy("r").agg(F.min("n").alias("first"))
    return c.join(first, "r", "left").select(*c.columns, F.coalesce(F.col("n") > F.col("first"), F.lit(False)).alias("skip"))


def publication_schedules(spark: SparkSession) -> DataFrame:
    """What becomes of a claimed state in each order of three events (its claimant stops, the claimant publishes, a helper
    recovers) under three protocols; only the first leaves a helper nothing to publish."""
    return spark.sql("""
        WITH p AS (SELECT explode(array('blind_drop', 'helpable_descriptor', 'logged_intent')) AS protocol),
        s AS (SELECT explode(array('stop,publish,recover', 'stop,recover,publish', 'publish,stop,recover', 'publish,recover,stop', 'recover,stop,publish', 'recover,publish,stop')) AS schedule),
        o AS (SELECT protocol, schedule, int(instr(schedule, 'publish') < instr(schedule, 'stop')) + int(protocol <> 'blind_drop') AS attempts FROM p, s)
        SELECT protocol, schedule, attempts > 0 AS published, attempts, least(attempts, 1) AS unique_publications FROM o""")
