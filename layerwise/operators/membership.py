"""Ways to keep the children that no known layer holds, and searches that move keys before states.

All give the same layers; a planner picks one by what is large. Covers JN1-JN6, JN9, BF14, BF15, SO2, ST1, ST7.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..plans.session import materialized, wrapping
from ..plans.spec import GraphError, GraphSpec

WAYS = ("aggregate", "anti", "sorted", "hashed", "bitmap")


def ordered(candidates: DataFrame, order: str = "none") -> DataFrame:
    """Candidates as they come, or sorted by state within partitions, so that equal ones lie side by side."""
    if order not in ("none", "radix"):
        raise GraphError("INVALID_CANDIDATE_ORDER")
    return candidates if order == "none" else candidates.sortWithinPartitions("state")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows that share ``keys`` the one that comes first by ``order``, by one aggregation with map-side minima."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__w")).select(*keys, "__w.*").select(*rows.columns)


def survivors(kids: DataFrame, known: DataFrame, how: str = "aggregate", rank: Column | None = None) -> DataFrame:
    """The distinct states of ``kids`` that ``known`` lacks.

    aggregate: one grouping of both by state. anti: distinct, then an anti join of Spark's choice. sorted and hashed: that
    join as a merge of sorted runs, or as a probe of hash tables, one per partition. bitmap: 64 states of neighbouring
    ranks are one word; ``rank`` (an expression on ``state``) must number states without collisions.
    """
    if how == "aggregate":
        both = kids.select("state", F.lit(1).alias("new")).unionByName(known.select("state", F.lit(0).alias("new")))
        return both.groupBy("state").agg(F.min("new").alias("new")).where("new = 1").select("state")
    if how in ("anti", "sorted", "hashed"):
        hint = {"sorted": "merge", "hashed": "shuffle_hash"}.get(how)
        return kids.select("state").distinct().join(known.select("state").hint(hint) if hint else known.select("state"), "state", "left_anti")
    if how != "bitmap" or rank is None:
        raise GraphError("INVALID_MEMBERSHIP")
    placed = lambda df: df.select("state", F.call_function("div", rank, F.lit(64)).alias("word"), F.pmod(rank, F.lit(64)).cast("int").alias("bit"))
    words = placed(known).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("held"))
    seen = F.call_function("shiftright", F.coalesce("held", F.lit(0).cast("long")), F.col("bit")).bitwiseAND(1)
    return placed(kids).distinct().join(words, "word", "left").where(seen == 0).select("state")


def layers_by(spark: SparkSession, spec: GraphSpec, how: str = "anti", batches: int = 1, rank: Column | None = None, order: str = "none") -> list[int]:
    """Layer sizes of an orbit (array states). With several ``batches`` a layer's parents are expanded in turns, and each turn
    also leaves out what those before it have accepted."""
    known = [materialized(spark.createDataFrame([(list(spec.start),)], "state array<bigint>"), "layer")[0]]
    sizes, rolling = [1], spec.inverse_closed()
    while sizes[-1]:
        cur, accepted, n = known[-1], [], 0
        for turn in range(batches):
            with wrapping(spark):
                some = cur if batches == 1 else cur.where(F.pmod(F.xxhash64("state"), F.lit(batches)) == turn)
                kids = ordered(some.select(F.explode(S.children(spec)).alias("state")), order)
                past = reduce(DataFrame.unionByName, [*(known[-2:] if rolling else known), *accepted])
                new, m = materialized(survivors(kids, past, how, rank), "accepted")
            accepted.append(new)
            n += m
        known.append(reduce(DataFrame.unionByName, accepted))
        sizes.append(n)
    return sizes[:-1]


def keyed_layers(spark: SparkSession, spec: GraphSpec, key: str = "lossless") -> DataFrame:
    """(depth, states) by a search that exchanges keys and origins only: each child is offered as its key with (parent's key,
    move); the least origin of each new key wins; winners look up their parents and make the state again.

    key: ``lossless`` (128 bits, of states that fit) or ``rank`` (the Lehmer rank, of distinct symbols 0..n-1).
    """
    n = len(spec.start)
    if spec.kind != "permutation" or min(spec.start) < 0 or key == "rank" and sorted(spec.start) != list(range(n)):
        raise GraphError("KEY_DOMAIN")
    bits = max(1, max(spec.start).bit_length())

    def keyed(state: str) -> Column:
        if key == "rank":
            return F.struct(S.lehmer_rank(state, n).alias("low"), F.lit(0).cast("long").alias("high"))
        low, high = S.lossless_key(state, n, bits)
        return F.struct(low.alias("low"), high.alias("high"))

    with wrapping(spark):
        start = spark.createDataFrame([(list(spec.start),)], "state array<bigint>")
        cur, size = materialized(start.select(keyed("state").alias("key"), "state"), "keyed")
        known, sizes, rolling = [cur.select("key")], [], spec.inverse_closed()
        while size:
            sizes.append(size)
            made = cur.select(F.col("key").alias("parent"), F.posexplode(S.children(spec)).alias("move", "child"))
            offers = made.select(keyed("child").alias("key"), F.struct("parent", "move").alias("origin")).groupBy("key").agg(F.min("origin").alias("origin"))
            past = reduce(DataFrame.unionByName, known[-2:] if rolling else known)
            won = offers.join(past, "key", "left_anti").select("key", "origin.parent", "origin.move")
            state = F.element_at(S.children(spec), F.col("move") + 1)
            cur, size = materialized(won.join(cur.select(F.col("key").alias("parent"), "state"), "parent").select("key", state.alias("state")), "keyed")
            known.append(cur.select("key"))
    return spark.createDataFrame(list(enumerate(sizes)), "depth int, states long")
