"""Archives of a search's last layers: layers committed one by one, adopted parts, selected samples, shared files.

A layer is a folder and then rows of the manifest, a Parquet table that is appended to; what has no row there isn't
committed. Covers SNK3, SNK4, SNK7, SNK8, SNK9.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import numbered
from .store import SAMPLE, cohorts, layer_digests

MANIFEST = "depth int, rank int, path string, first_state_ordinal long, states long, width int, seconds double, content_sha256 string"
SHARD_BYTES, GROUP_ROWS, ROW_BYTES = 512_000_000, 262_144, 14  # uncompressed; a row has so many besides its state


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    p, fs = _path(spark, f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest") if fs.exists(p) else spark.createDataFrame([], MANIFEST)


def _next(spark: SparkSession, folder: str, depth: int, seconds: float) -> None:
    if depth != manifest(spark, folder).select("depth").distinct().count():
        raise ValueError("TAIL_DEPTH")
    if not (math.isfinite(seconds) and seconds >= 0):
        raise ValueError("TAIL_SECONDS")


def _shape(df: DataFrame, count: int, width: int) -> None:
    got = df.agg(F.count("*"), F.count_if(F.length("state").eqNullSafe(width))).first()
    if got[0] != count:
        raise ValueError("TAIL_COUNT")
    if got[1] != count:
        raise ValueError("TAIL_WIDTH")


def _digest(df: DataFrame) -> str | None:
    got = layer_digests(df.select(F.lit(0).alias("depth"), F.lit(0).alias("rank"), F.col("ordinal").alias("rank_ordinal"), "state")).first()
    return got.content_sha256 if got else None


def commit_layer(layer: DataFrame, folder: str, depth: int, count: int, width: int, seconds: float) -> None:
    """Write a whole layer (state as bytes of ``width``) in the order of its states, and then its row of the manifest. Depths
    follow each other; the layer must have ``count`` states."""
    spark = layer.sparkSession
    _next(spark, folder, depth, seconds)
    placed, _ = numbered(layer.select("state"), ["state"], "ordinal", "tail")
    _shape(placed, count, width)
    path = f"layers/depth={depth}"
    placed.sortWithinPartitions("ordinal").write.parquet(f"{folder}/{path}")
    rows = [(depth, 0, path, 0, count, width, float(seconds), _digest(spark.read.parquet(f"{folder}/{path}")))]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def adopt_parts(spark: SparkSession, parts: list[tuple[str, int]], folder: str, depth: int, width: int, seconds: float) -> None:
    """Commit a layer of closed parts (folder with columns ordinal and state, states), one for each rank in order: they are
    renamed and not copied, and their states are numbered one after the other. All parts are checked before one moves,
    and moved back if one can't be."""
    _next(spark, folder, depth, seconds)
    rows, first = [], 0
    for rank, (source, count) in enumerate(parts):
        df = spark.read.parquet(source)
        _shape(df, count, width)
        rows.append((depth, rank, f"layers/depth={depth}-rank={rank:04d}", first, count, width, float(seconds), _digest(df)))
        first += count
    moved = []
    try:
        for (source, _), row in zip(parts, rows, strict=True):
            a, fs = _path(spark, source)
            b, _ = _path(spark, f"{folder}/{row[2]}")
            fs.mkdirs(b.getParent())
            if fs.exists(b) or not fs.rename(a, b):
                raise ValueError("TAIL_PART_EXISTS")
            moved.append((fs, a, b))
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    except BaseException:
        for fs, a, b in reversed(moved):
            fs.rename(b, a)
        raise


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    """(depth, ordinal, state) of the committed layers, parts in the order of their ranks."""
    out = spark.createDataFrame([], "depth int, ordinal long, state binary")
    for r in manifest(spark, folder).orderBy("depth", "rank").collect():  # one row per layer and rank
        part = spark.read.parquet(f"{folder}/{r.path}")
        out = out.unionByName(part.select(F.lit(r.depth).alias("depth"), (F.col("ordinal") + r.first_state_ordinal).alias("ordinal"), "state"))
    return out


def selected(states: DataFrame, sizes: DataFrame, complete: bool, most: int = SAMPLE) -> DataFrame:
    """(depth, ordinal, state) that a selected tail keeps of states (depth, rank, rank_ordinal from 0 in a layer, state) and
    layers (depth, states): of a complete search the whole layers of up to ``most`` states and the last one whole; of
    another only the first ``most`` of the last. The order is by rank. A rank offers its first ``most`` to a sample."""
    last = sizes.agg(F.max("depth").alias("last"))
    s = states.join(sizes, "depth").join(last)
    small = s.where((F.col("states") <= most) if complete else (F.col("depth") == F.col("last"))).where(F.col("rank_ordinal") < most)
    place = F.row_number().over(Window.partitionBy("depth").orderBy("rank", "rank_ordinal")) - 1  # ranks * most rows at most
    small = small.withColumn("ordinal", place.cast("long")).where(F.col("ordinal") < most).select("depth", "ordinal", "state")
    if not complete:
        return small
    ranks = states.join(sizes, "depth").join(last).where((F.col("depth") == F.col("last")) & (F.col("states") > most))
    before = ranks.groupBy("rank").agg(F.count("*").alias("n"))
    before = before.select("rank", (F.sum("n").over(Window.orderBy("rank")) - F.col("n")).alias("before"))  # one row per rank
    return small.unionByName(ranks.join(before, "rank").select("depth", (F.col("before") + F.col("rank_ordinal")).alias("ordinal"), "state"))


def to_parquet(tail: DataFrame, path: str, width: int, shard_bytes: int = SHARD_BYTES, group_rows: int = GROUP_ROWS) -> int:
    """Write tail rows (n, r, depth, ordinal, state) as zstd Parquet in files of about ``shard_bytes`` uncompressed and row
    groups of ``group_rows``; a file holds one layer. Returns the rows a file may have."""
    if shard_bytes < 1 or group_rows < 1 or not 8 <= width <= 128 or width % 8:
        raise ValueError("TAIL_PARQUET_BOUNDS")
    rows = max(1, shard_bytes // (width + ROW_BYTES))
    ranged = tail.repartitionByRange("n", "r", "depth", "ordinal").sortWithinPartitions("n", "r", "depth", "ordinal")
    out = ranged.write.option("compression", "zstd").option("maxRecordsPerFile", rows).option("parquet.block.row.count.limit", group_rows)
    out.partitionBy("n", "r", "depth").parquet(path)
    return rows


def write_cohorts(tails: DataFrame, cases: list[tuple[str, int, int]], path: str, most: int = 20, most_bytes: int = 2_000_000_000) -> list[list[str]]:
    """Write the rows of many cases (column ``case``) into files that the cases of a cohort share; see ``store.cohorts`` for
    the cases (key, width, bytes). Returns the cohorts."""
    if len({k for k, _, _ in cases}) != len(cases) or any(k in ("", ".", "..") or "/" in k or "\\" in k for k, _, _ in cases):
        raise ValueError("COHORT_CASE")
    groups = cohorts(cases, most, most_bytes)
    of = tails.sparkSession.createDataFrame([(k, i) for i, g in enumerate(groups) for k in g], "case string, cohort int")
    placed = tails.join(of, "case").repartitionByRange("cohort", "case", "depth", "ordinal").sortWithinPartitions("cohort", "case", "depth", "ordinal")
    placed.write.partitionBy("cohort").option("compression", "zstd").parquet(path)
    return groups
