"""What a search needs from a session: the shared folder, cut lineage, and settings that are restored afterwards."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 400_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where that is unset, a folder of our own on a local master
    (tests) only."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="layerwise-"))
    return str(jsc.getCheckpointDir().get()).rstrip("/")


def materialized(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read again, and its rows: one job, and lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out, int(seen.get["n"])


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialized`` that nothing reads any more; other frames are left alone."""
    if stored := getattr(df, "_stored", None) if "_stored" in df.__dict__ else None:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(stored)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the loop (dots for double underscores), restored on the way out."""
    old = {}
    for k, v in conf.items():
        k = k.replace("__", ".")
        old[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def wrapping(spark: SparkSession):
    """Frames that are built inside have integer arithmetic that wraps: ANSI mode is bound when a frame is analysed."""
    return settings(spark, spark__sql__ansi__enabled="false")


def sized(spark: SparkSession, rows: int):
    """Few partitions for small layers, the cluster's own number at most for large ones; no re-planning between the
    stages of layers that one partition holds."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(most, -(-rows // ROWS_PER_PARTITION)))
    return settings(spark, spark__sql__shuffle__partitions=str(n), spark__sql__adaptive__enabled=str(n > 16).lower())


def numbered(df: DataFrame, order: list[str], name: str, what: str) -> tuple[DataFrame, int]:
    """``df`` with its place (from 0) in the order of the columns, without one task that sees all rows: ranges are sorted
    by themselves, and each one's rows are counted from the sum of those before it (one row per range)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("__id", F.monotonically_increasing_id())
    ranged, n = materialized(ranged.withColumn("__part", F.shiftright("__id", 33)), what)
    counts = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}  # as many rows as partitions
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    if not starts:
        return ranged.select(*df.columns, F.lit(0).cast("long").alias(name)), 0
    offset = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    place = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(offset), "__part").select(*df.columns, place.alias(name)), n  # one row per partition


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small new file in any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(data))
    out.close()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
