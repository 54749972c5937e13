"""What the operators share: the shared folder, cut lineage, joined components, small text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one of our own on a
    local master (tests) only."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="layerwise-"))
    return str(jsc.getCheckpointDir().get()).rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._stored)
    path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch of what is run meanwhile: whole texts are long, and a batch of Spark's
    10,000 stands in the executor's and in the worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def trim() -> None:
    """Give a worker's freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_fold(col, modulus: int, remainder: int):
    """True where crc32 of the id as decimal text leaves ``remainder``; a null id is in no such fold."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table by alternating large-star and small-star steps.

    Returns (node, component): the smallest node reachable, one row for each node that has an edge.
    Each step groups by node with map-side minima only (no neighbour list is gathered), so one node with
    very many edges costs a join whose skew Spark can split; a chain of n nodes ends in about log n steps.
    Nulls and self links are ignored; an empty table gives an empty result.
    """
    e = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    while True:
        # large-star: each node's neighbours above it go to the smallest node around it
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        ).where("u > v").distinct()
        # small-star: each node's smaller neighbours and itself go to the smallest of them
        small = stored(large, "large")
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        nxt = stored(
            small.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u > v").distinct(),
            "small",
        )
        # done when no node is both a child and a parent, and each child has one parent
        roots = nxt.select(F.col("v").alias("u")).distinct()
        left = nxt.join(roots, "u", "left_semi").limit(1).count() + nxt.groupBy("u").count().where("count > 1").limit(1).count()
        discard(e)
        discard(small)
        e = nxt
        if not left:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
