"""Datasets of schema 1: tables of states, layers and runs, and a manifest with the SHA-256 of each file. Covers SNK10, FL11."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..operators.search import Layers
from ..plans.session import materialized, numbered, write_bytes
from .archive import opened
from .store import layer_digests, report
from .tails import _path

HASH = "GEMM_U8_P32X4_V1"
#: Columns of the layers table that a search may measure; null if it didn't.
COUNTED = ("generated_candidates", "source_duplicates", "visited_duplicates", "same_depth_duplicates", "routed_records", "routed_bytes", "peak_future_records")
TIMED = ("generation_ms", "hash_ms", "sort_ms", "exchange_ms", "owner_ms", "materialize_ms", "archive_d2h_ms", "wall_ms", "owner_imbalance")
FILES = "path string, bytes long, sha256 string"


def tables(result: Layers, run_id: str, group_id: str, seed: bytes = bytes(16), world: int = 1, shards: int = 1, buckets: int = 1, metrics: dict[int, dict] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, layers, runs) of a whole search whose labels are bytes. A state's owner, shard and bucket are the top bits of
    its hash; its rank_ordinal is its place among all records of its rank. What wasn't measured is null, never 0."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", run_id):
        raise ValueError("RUN_ID_PATH")
    if result.status != "COMPLETE":
        raise ValueError("RUN_NOT_COMPLETE")
    spark, digest, width, metrics = result.spark, result.spec.digest(), len(result.spec.start), metrics or {}
    ids = [F.lit(group_id).alias("group_id"), F.lit(digest).alias("config_digest")]
    lanes = S.modular_hash("state", width, seed)
    owner, shard, bucket = S.located(S.high_word(lanes), world, shards, buckets)
    s = result.states().select("depth", owner.cast("int").alias("rank"), S.state_bytes("state").alias("state"), owner.cast("int").alias("logical_owner"), shard.cast("int").alias("shard"), bucket.cast("int").alias("bucket"), S.hash_bytes(lanes).alias("hash128_le"))
    placed, _ = numbered(s, ["rank", "depth", "state"], "place", "dataset")
    first = placed.groupBy("rank").agg(F.min("place").alias("first"))  # one row per rank
    placed = placed.join(first, "rank")
    states = placed.select(*ids, "rank", "depth", (F.col("place") - F.col("first")).alias("rank_ordinal"), "logical_owner", "shard", "bucket", "state", "hash128_le")
    measured = spark.createDataFrame([(d, *[m.get(c) for c in COUNTED], *[m.get(c) for c in TIMED], json.dumps(m, sort_keys=True, separators=(",", ":"))) for d, m in metrics.items()], ", ".join(["depth int", *[f"{c} long" for c in COUNTED], *[f"{c} double" for c in TIMED], "metrics_json string"]))
    layers = result.counts().join(layer_digests(states, "hash128_le"), "depth").join(measured, "depth", "left")
    layers = layers.select(*ids, "depth", F.col("states").alias("unique_states"), F.lit(width).alias("state_bytes"), (F.col("states") * (width + 16)).alias("archive_payload_bytes"), "content_sha256", *COUNTED, *TIMED, F.coalesce("metrics_json", F.lit("{}")).alias("metrics_json"))
    summary = report(result) | {"hash": {"algorithm": HASH, "seed_u128": str(int.from_bytes(seed, "little"))}, "topology": {"world_size": world, "shards_per_rank": shards, "buckets_per_shard": buckets}}
    runs = spark.range(1).select(*ids, F.lit(result.status).alias("status"), F.lit(result.num_vertices()).cast("long").alias("total_unique_states"), F.lit(result.completed_depth).alias("max_depth"), F.lit(json.dumps(summary, sort_keys=True, separators=(",", ":"))).alias("summary_json"))
    return states, layers, runs


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of the files below ``paths``, streamed in tasks; every executor must reach them by pyarrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                h, n = hashlib.sha256(), 0
                with opened(name) as f:
                    while some := f.read(1 << 20):
                        h.update(some)
                        n += len(some)
                yield pa.RecordBatch.from_pydict({"path": [name], "bytes": pa.array([n], pa.int64()), "sha256": [h.hexdigest()]})

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths).select("path")
    return listed.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, FILES)


def write(data: tuple[DataFrame, DataFrame, DataFrame], path: str, run_id: str) -> None:
    """Write a run's tables below run_id=..., then its manifest, which makes it valid. A run that is there is refused."""
    spark = data[0].sparkSession
    target, fs = _path(spark, f"{path}/manifest-{run_id}.json")
    folders = [f"{path}/{t}/run_id={run_id}" for t in ("states", "layers", "runs")]
    if fs.exists(target) or any(fs.exists(_path(spark, f)[0]) for f in folders):
        raise FileExistsError(run_id)
    for folder, df in zip(folders, data, strict=True):
        df.write.option("compression", "zstd").parquet(folder)
    run = spark.read.parquet(folders[2]).first()
    files = digests(spark, folders).select(F.regexp_extract("path", r"((?:states|layers|runs)/run_id=.*)$", 1).alias("path"), "bytes", "sha256").orderBy("path").collect()  # one row per file
    body = {"schema": "DATASET_V1", "run_id": run_id, "group_id": run.group_id, "config_digest": run.config_digest, "total_unique_states": run.total_unique_states, "max_depth": run.max_depth, "files": [f.asDict() for f in files]}
    write_bytes(spark, f"{path}/manifest-{run_id}.json", json.dumps(body, indent=2).encode())


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/{table}")
    return df.withColumn("run_id", F.col("run_id").cast("string"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(error, detail) of all runs: manifests that don't name their files' bytes and SHA-256, several widths, hashes that
    aren't those of their states, repeated states, counts by depth and in all, and the largest depth."""
    say = lambda df, code, detail: df.select(F.lit(code).alias("error"), detail.cast("string").alias("detail"))
    file = "struct<path:string,bytes:bigint,sha256:string>"
    listed = spark.read.schema(f"schema string, run_id string, total_unique_states long, max_depth int, files array<{file}>").json(f"{path}/manifest-*.json", multiLine=True)
    listed, _ = materialized(listed, "manifests")
    states, layers, runs = (read(spark, path, t) for t in ("states", "layers", "runs"))
    out = say(listed.where("schema IS DISTINCT FROM 'DATASET_V1'"), "DATASET_SCHEMA", F.col("run_id"))
    named = listed.select(F.explode("files").alias("f")).select("f.path", F.col("f.bytes").alias("b"), F.col("f.sha256").alias("h"))
    found = digests(spark, [f"{path}/{t}" for t in ("states", "layers", "runs")]).select(F.regexp_extract("path", r"((?:states|layers|runs)/run_id=.*)$", 1).alias("path"), "bytes", "sha256")
    out = out.unionByName(say(named.join(found, "path", "full").where("NOT (b <=> bytes AND h <=> sha256)"), "PARQUET_MANIFEST_MISMATCH", F.col("path")))
    width = layers.groupBy("run_id").agg(F.min("state_bytes").alias("width"), F.max("state_bytes").alias("most"))
    out = out.unionByName(say(width.where("width <> most"), "STATE_WIDTH_MISMATCH", F.col("run_id")))
    out = out.unionByName(say(states.join(width, "run_id").where("length(state) <> width"), "STATE_WIDTH", F.hex("state")))
    seeds = {}
    for r in runs.join(width, "run_id", "left").collect():  # one row per run
        spec = json.loads(r.summary_json).get("hash", {})
        if spec.get("algorithm") == HASH and r.width:
            seeds.setdefault((r.width, spec["seed_u128"]), []).append(r.run_id)
    for (n, seed), ids in seeds.items():
        mine = states.where(F.col("run_id").isin(ids)).where(F.length("state") == n)
        x = mine.select("state", "hash128_le", F.expr(f"transform(sequence(1, {n}), i -> bigint(conv(hex(substring(state, i, 1)), 16, 10)))").alias("x"))
        right = S.hash_bytes(S.modular_hash("x", n, int(seed).to_bytes(16, "little")))
        out = out.unionByName(say(x.where(~right.eqNullSafe(F.col("hash128_le"))), "HASH_STATE_MISMATCH", F.hex("state")))
    out = out.unionByName(say(states.groupBy("run_id", "state").count().where("count > 1"), "DUPLICATE_STATE", F.col("run_id")))
    n = states.groupBy("run_id", "depth").agg(F.count("*").alias("n"))
    out = out.unionByName(say(layers.join(n, ["run_id", "depth"], "full").where("NOT n <=> unique_states"), "DATASET_COUNTS", F.concat_ws("/", "run_id", "depth")))
    total = n.groupBy("run_id").agg(F.sum("n").alias("s"), F.max("depth").alias("d"))
    for df in (runs, listed):
        out = out.unionByName(say(df.join(total, "run_id", "left").where("NOT (s <=> total_unique_states AND d <=> max_depth)"), "DATASET_COUNTS", F.col("run_id")))
    return out.distinct()
