"""Operator 9, mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 9
BITS, LEVELS = 8, 3  # a source's order is cut into 256 buckets, the bucket at the cut into 256 again, and so on


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt out by weight, none above ``most`` times its source.

    Sources in code point order, null last, take the weights in turn. In the order of limit / weight the sources
    that reach their limit come first, which gives the level that the others share in one pass over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")).alias("w"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    limit = most * F.col("source_size")
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("full", limit <= F.col("w") * F.col("level"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return per.select("source", "source_size", F.when(F.col("full"), limit).otherwise(F.col("w") * shared).alias("target"))


def _ranked(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """``docs`` (source, size, u) with its source's row of ``cuts`` and the Pareto rank q: random odds over inclusion odds."""
    joined = docs.join(cuts.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    q = F.when(F.col("part") > 0, odds)
    joined = joined.withColumn("q", q)
    return joined.withColumn("place", F.floor(F.col("q") / (1 + F.col("q")) * (1 << LEVELS * BITS)).cast("long"))


def cut(sized: DataFrame, **options) -> DataFrame:
    """For each source: source_size, target, whole (copies that every document gets), part (inclusion probability of one
    more), and where the sample ends: ``place`` of the last bucket and ``q`` of the last document in it.

    The sample takes documents in the order of q until its words come nearest to what is left of the target. Sums of
    three levels of buckets find the last bucket, so that only about one row in 16 million of a source is ordered.
    """
    aims = targets(sized, **options)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("whole", F.floor(ratio + 1e-12).cast("long")).withColumn("part", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    aims = aims.withColumn("part", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")))
    aims = common.stored(aims, "aims")  # one row per source, of known size: Spark broadcasts it only while it is small
    goal = aims.withColumn("left", F.col("part") * F.col("source_size"))
    ranked = _ranked(sized, goal.select("source", "part", "left")).where("part > 0")
    done = F.lit(0.0)
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("place", (LEVELS - level) * BITS)
        sums = ranked.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"), *([] if level == 1 else [F.first("done").alias("done")]))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # 256 rows at most
        sums = sums.select("source", "bucket", "n", "left", (upto - F.col("n") + done).alias("before"))
        # the first bucket that reaches what is left; buckets before it are whole
        ends = sums.where(F.col("before") + F.col("n") >= F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("x"))
        ends = common.stored(ends.select(F.col("source").alias("__s"), F.col("x.bucket").alias("end"), F.col("x.before").cast("double").alias("done")), "ends")
        ranked = ranked.drop("done", "end").join(ends, F.col("source").eqNullSafe(F.col("__s")) & (bucket == F.col("end"))).drop("__s")
        done = F.col("done")
    group = ranked.groupBy("source", "q").agg(F.sum("size").alias("n"), F.first("left").alias("left"), F.first("done").alias("done"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("q")) - F.col("n")
    last = group.withColumn("before", before).where(F.col("done") + F.col("before") + F.col("n") / 2 <= F.col("left")).groupBy("source").agg(F.max("q").alias("last_q"))
    ends = ends.join(last, F.col("__s").eqNullSafe(F.col("source")), "left").select("__s", "end", F.coalesce("last_q", F.lit(-1.0)).alias("last_q"))
    out = aims.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left")
    return common.stored(out.select("source", "source_size", "target", "whole", "part", "end", "last_q"), "cuts")


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), the same in each run and engine: 52 bits of the MD5 of the seed, the id and the text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id, F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _copies() -> Column:
    chosen = (F.col("part") > 0) & ((F.col("place") < F.col("end")) | ((F.col("place") == F.col("end")) & (F.col("q") <= F.col("last_q"))))
    return F.col("whole") + F.coalesce(chosen.cast("long"), F.lit(0))


def mixed(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A source's documents each get the whole copies that target / source words allow; one more copy goes to a
    fixed-size sample whose inclusion probability is the fraction. Null texts have size 0; a null source is a source,
    the last; a source without words takes nothing. Rows that repeat id and text stand or fall together. The same
    rows give the same mix in any run and partitioning. Other columns are not read.
    """
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), _uniform(F.col("doc_id").cast("string"), F.col("text").cast("string"), seed).alias("u"))
    sized = common.stored(sized, "sizes")
    copies = _ranked(sized, cut(sized.drop("doc_id"), **options)).withColumn("copies", _copies())
    return copies.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents as often as the mix takes them, all columns as they were. The texts are read twice, never shuffled."""
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("string")
    sized = common.stored(docs.select(F.col("source").cast("string").alias("source"), words(text).alias("size"), _uniform(key, text, seed).alias("u")), "sizes")
    cuts = cut(sized, **options)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), _uniform(key, text, seed).alias("u"))
    times = _ranked(whole, cuts).withColumn("copies", _copies())
    return times.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.documents(spark, sf_dir)).drop("copies")


#: The same mix without buckets: each source's documents in the order of q, and their running sum.
SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST({list(map(float, WEIGHTS))}[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w FROM d GROUP BY source),
lev AS (SELECT *, {MOST}::DOUBLE * n AS most, ({SHARE}::DOUBLE * sum(n) OVER () - coalesce(sum({MOST}::DOUBLE * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per WINDOW o AS (ORDER BY CAST(n AS DOUBLE) / w, encode(source) NULLS LAST)),
aim AS (SELECT source, n, CASE WHEN most <= w * level THEN most ELSE w * max(CASE WHEN most > w * level THEN level END) OVER () END AS target FROM lev),
r AS (SELECT source, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS ratio FROM aim),
f AS (SELECT source, n, target, floor(ratio + 1e-12) AS whole, CASE WHEN greatest(0, ratio - floor(ratio + 1e-12)) < 1e-9 THEN 0 ELSE greatest(0, ratio - floor(ratio + 1e-12)) END AS part FROM r),
q AS (SELECT d.*, f.n, f.target, f.whole, f.part, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
g AS (SELECT source, q, sum(size) AS s, any_value(part * n) AS left_ FROM q WHERE part > 0 GROUP BY source, q),
c AS (SELECT source, q FROM (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY q) - s AS before FROM g) WHERE before + s / 2 <= left_),
e AS (SELECT source, max(q) AS last FROM c GROUP BY source)
SELECT doc_id, size, n AS source_size, target, CAST(size * (whole + CASE WHEN q <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q LEFT JOIN e ON q.source IS NOT DISTINCT FROM e.source
"""
