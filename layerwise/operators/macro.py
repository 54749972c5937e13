"""Macro generators (the ball of words of up to K moves) and the weighted search over them. Covers BF9, BF10, SO7, PR28, BF24, AG20."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..plans.session import materialized, sized, wrapping
from ..plans.spec import GraphError, GraphSpec, identity, matrix, permutation


@dataclass(frozen=True)
class Macro:
    operator: tuple
    weight: int
    word: tuple[int, ...]


def compile_macros(spec: GraphSpec, depth: int, capacity: int = 1 << 16, budget: int = 1 << 24) -> list[Macro]:
    """Distinct operators of words of up to ``depth`` moves, each with its least length and first word in shortlex order."""
    if depth < 1:
        raise GraphError("MACRO_DEPTH_ZERO")
    n = spec.rows
    unit = identity(len(spec.start)) if spec.kind == "permutation" else tuple(int(r == c) for r in range(n) for c in range(n))

    def then(op, g):
        if spec.kind == "permutation":
            return tuple(op[i] for i in spec.generators[g])
        flat, q = spec.generators[g]
        return tuple(sum(flat[r * n + k] * op[k * n + c] for k in range(n)) % q for r in range(n) for c in range(n))

    found, level, steps = {unit: ()}, [unit], 0
    for _ in range(depth):
        new = []
        for op in level:
            for g in range(len(spec.generators)):
                steps += 1
                if steps > budget:
                    raise GraphError("MACRO_TRANSITION_BUDGET")
                child = then(op, g)
                if child not in found:
                    found[child] = (*found[op], g)
                    new.append(child)
                    if len(found) - 1 > capacity:
                        raise GraphError("MACRO_GENERATOR_CAPACITY")
        level = new
    return [Macro(op, len(w), w) for op, w in found.items() if w]


def macro_frame(spark: SparkSession, macros: list[Macro]) -> DataFrame:
    rows = [(i, list(m.operator), m.weight, list(m.word)) for i, m in enumerate(macros)]
    return spark.createDataFrame(rows, "ordinal int, operator array<bigint>, weight int, word array<int>")


#: Fixed value: what offers of one state and depth are compared by, in this order.
KEY = ("source_depth", "weight", "source_rank", "source_batch", "ordinal")


def winners(offers: DataFrame) -> DataFrame:
    """Of offers (depth, state, and KEY) one for each state: the least depth, then the least key."""
    best = F.min(F.struct("depth", *KEY)).alias("w")
    return offers.groupBy("state").agg(best).select("w.*", "state")


def weighted_search(spark: SparkSession, spec: GraphSpec, depth: int) -> DataFrame:
    """(depth, state, and KEY of the offer that settled it) by weighted settling: offers wait in a table, the least depth is
    settled, each state once, by its least key. The start has a key of zeros. One rank and one batch a depth here."""
    macros = compile_macros(spec, depth)
    whole = permutation("m", [m.operator for m in macros], spec.start) if spec.kind == "permutation" else matrix("m", [(m.operator, spec.generators[0][1]) for m in macros], spec.start, spec.rows, spec.cols)
    weights = F.array(*[F.lit(m.weight) for m in macros])
    kind = "depth int, source_depth int, weight int, source_rank int, source_batch int, ordinal int, state array<bigint>"
    pending, left = spark.createDataFrame([(0, 0, 0, 0, 0, 0, list(spec.start))], kind), 1
    settled, at, last = [], 0, 1
    while left:
        due = pending.where(F.col("depth") == at)
        with sized(spark, last * len(macros)), wrapping(spark):
            if settled:
                due = due.join(reduce(DataFrame.unionByName, [x.select("state") for x in settled]), "state", "left_anti")
            cur, n = materialized(winners(due), "settled")
            if n:
                settled.append(cur)
                last = n
            kids = cur.select(F.posexplode(S.children(whole)).alias("ordinal", "state")).withColumn("weight", weights[F.col("ordinal")])
            kids = kids.select((F.col("weight") + at).alias("depth"), F.lit(at).alias("source_depth"), "weight", F.lit(0).alias("source_rank"), F.lit(at).alias("source_batch"), "ordinal", "state")
            pending, left = materialized(winners(pending.where(F.col("depth") > at).unionByName(kids)).select(*pending.columns), "pending")
        at += 1
    return reduce(DataFrame.unionByName, settled)


def weighted_layers(spark: SparkSession, spec: GraphSpec, depth: int) -> list[int]:
    """Layer sizes of ``weighted_search``; an index is a depth. Equal to the plain layers for any ``depth``."""
    got = {r.depth: r.n for r in weighted_search(spark, spec, depth).groupBy("depth").agg(F.count("*").alias("n")).collect()}  # one row per depth
    return [got.get(d, 0) for d in range(max(got) + 1)]


def commutation(spec: GraphSpec) -> list[list[bool]]:
    n = len(spec.start)
    g = spec.generators
    return [[all(a[b[i]] == b[a[i]] for i in range(n)) for b in g] for a in g]


def trace_normal_form(word, commute, inverse_of=None) -> tuple[int, ...]:
    """The least word that swaps of adjacent commuting letters reach: repeatedly the least letter that all before it
    commute with. With ``inverse_of``, x x counts as its inverse twice and the smaller of both is taken."""
    if inverse_of is not None:
        seen, todo, best = set(), [tuple(word)], None
        while todo:
            w = trace_normal_form(todo.pop(), commute)
            if w in seen:
                continue
            seen.add(w)
            best = w if best is None or w < best else best
            todo += [(*w[:i], inverse_of[w[i]], inverse_of[w[i]], *w[i + 2 :]) for i in range(len(w) - 1) if w[i] == w[i + 1]]
        return best
    left, out = list(word), []
    while left:
        free = [i for i, x in enumerate(left) if all(commute[x][y] and x != y for y in left[:i])]
        out.append(left.pop(min(free, key=lambda i: left[i])))
    return tuple(out)


def reduced_words(spark: SparkSession, spec: GraphSpec, length: int) -> DataFrame:
    """(word, state) of words of ``length`` moves without a move right after its inverse."""
    g = spec.generators
    back = [next((j for j, h in enumerate(g) if all(a[h[i]] == i for i in range(len(h)))), -1) for a in g]
    banned = F.array(*[F.lit(b) for b in back])
    out = spark.createDataFrame([([], list(spec.start))], "word array<int>, state array<bigint>")
    with wrapping(spark):
        for step in range(length):
            out = out.select("word", F.posexplode(S.children(spec)).alias("m", "state"))
            if step:
                out = out.where(banned[F.element_at("word", -1)] != F.col("m"))
            out = out.select(F.concat("word", F.array("m")).alias("word"), "state")
    return out


def word_audit(words: DataFrame, commute) -> DataFrame:
    """Of words (word, state): endpoints, words beyond one per endpoint, trace classes, and most classes at an endpoint."""

    @F.pandas_udf("array<int>")
    def normal(w):
        return w.map(lambda x: list(trace_normal_form([int(v) for v in x], commute)))

    per = words.withColumn("trace", normal("word")).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("trace").alias("classes"))
    return per.agg(F.count("*").alias("endpoints"), F.sum("n").alias("words"), (F.sum("n") - F.count("*")).alias("extra_words"), F.sum("classes").alias("classes"), F.max("classes").alias("most_classes"))
