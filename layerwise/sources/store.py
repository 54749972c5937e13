"""Result stores: states by layer, retention, ordinals, receipts, ledgers; tails.py and dataset.py have the rest.

Covers SRC29-SRC32, SNK1, SNK5, SNK6, SNK11, SO3-SO5, SO9, SO10, AG17-AG19.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.search import Layers
from ..plans.session import materialized, numbered

SAMPLE = 1_000
TAIL = "n smallint, r smallint, depth int, ordinal bigint, state binary"


def write_states(result: Layers, path: str) -> None:
    """All retained layers, one folder per depth, so a scan of a depth reads nothing else."""
    result.states().write.partitionBy("depth").parquet(path)


def read_states(spark: SparkSession, path: str, depths=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if depths is None else df.where(F.col("depth").isin(list(depths)))


def read_tail(spark: SparkSession, path: str, n: int | None = None, r: int | None = None, depths=None) -> DataFrame:
    """Tail rows; the conditions reach the scan (partition and row-group pruning)."""
    df = spark.read.schema(TAIL).parquet(path)
    for name, value in (("n", n), ("r", r)):
        df = df if value is None else df.where(F.col(name) == value)
    return df if depths is None else df.where(F.col("depth").isin(list(depths)))


def with_ordinals(states: DataFrame) -> DataFrame:
    """(depth, ordinal, state): places from 0 in each layer, layers and states in order, without a global window."""
    placed, _ = numbered(states.select("depth", "state"), ["depth", "state"], "place", "ordinals")
    first = placed.groupBy("depth").agg(F.min("place").alias("first"))
    return placed.join(first, "depth").select("depth", (F.col("place") - F.col("first")).alias("ordinal"), "state")


def packed_states(states: DataFrame, bits: int) -> DataFrame:
    """States as bytes: symbol i at bits i * bits, little-endian, whole 8-byte words."""
    per = 64 // bits

    def word(w):
        return F.aggregate(F.transform(w, lambda x, i: F.call_function("shiftleft", x, (i * bits).cast("int"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    words = F.transform(F.sequence(F.lit(0), F.floor((F.size("state") - 1) / per).cast("int")), lambda k: word(F.slice("state", k * per + 1, per)))
    text = F.array_join(F.transform(words, lambda w: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(w), 16, "0"), F.lit("(..)"), F.lit(1))), "")), "")
    return states.withColumn("state", F.unhex(text))


def retained(layers: DataFrame, policy: str = "complete_bytes", keep: int = 3, least_bytes: int = 10_000_000_000) -> DataFrame:
    """Layers (depth, states, bytes) that a policy keeps.

    complete_bytes: the oldest go while more than ``keep`` stay and those that stay have ``least_bytes``. last: the last
    ``keep``. small: the last, and the one before it if it has fewer than SAMPLE states.
    """
    later = Window.orderBy(F.col("depth").desc())  # one row per layer
    m = layers.withColumn("rank", F.row_number().over(later)).withColumn("newer", F.sum("bytes").over(later) - F.col("bytes"))
    rule = {"complete_bytes": (F.col("rank") <= keep) | (F.col("newer") < least_bytes), "last": F.col("rank") <= keep, "small": (F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("states") < SAMPLE))}[policy]
    return m.where(rule).select(*layers.columns)


def snapshot(ordinals: DataFrame, layers: DataFrame, complete: bool, width: int, most_bytes: int = 1_000_000_000) -> DataFrame:
    """COMPLETE keeps the layers' states whole; INCOMPLETE the last ``most_bytes`` of packed records, so that the oldest
    layer kept may start at an ordinal above 0."""
    if complete:
        return ordinals.join(layers.select("depth"), "depth", "left_semi")
    later = Window.orderBy(F.col("depth").desc())
    m = layers.select("depth", "states", (F.sum("states").over(later) - F.col("states")).alias("newer"))
    start = m.select("depth", F.greatest(F.lit(0), F.col("states") - F.greatest(F.lit(0), most_bytes // width - F.col("newer"))).alias("start"))
    return ordinals.join(start, "depth").where("ordinal >= start").drop("start")


def layer_summary(layers: DataFrame) -> DataFrame:
    """(depth, states, cumulative, live): running sum, and the sum of a layer and the two before it."""
    w = Window.orderBy("depth")
    return layers.select("depth", "states", F.sum("states").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), F.sum("states").over(w.rowsBetween(-2, 0)).alias("live"))


def layer_digests(states: DataFrame, hashes: str | None = None) -> DataFrame:
    """(depth, content_sha256): SHA-256 of each layer's records by rank and ordinal, a record being its rank (u32,
    little-endian), its state and, if a column of that name is given, its hash. A chain of hashing has no parallel form:
    one task reads a layer, from a sort that spills, a batch at a time."""
    le = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex("rank"), 8, "0"), F.lit("(..)"), F.lit(1))), ""))
    record = F.concat(le, F.col("state"), *([F.col(hashes)] if hashes else []))
    # rows without a state or rank have no record; a layer of nothing else has no digest
    rows = states.select("depth", "rank", "rank_ordinal", record.alias("record")).where("record IS NOT NULL").repartition("depth").sortWithinPartitions("depth", "rank", "rank_ordinal").select("depth", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        done: list[tuple[int, str]] = []
        for b in batches:
            for depth, record in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if depth != at or h is None:
                    if h is not None:
                        done.append((at, h.hexdigest()))
                    at, h = depth, hashlib.sha256()
                h.update(record.as_buffer())
        if h is not None:
            done.append((at, h.hexdigest()))
        yield pa.RecordBatch.from_pydict({"depth": pa.array([d for d, _ in done], pa.int32()), "content_sha256": pa.array([x for _, x in done], pa.string())})

    return rows.select(F.col("depth").cast("int").alias("depth"), "record").mapInArrow(run, "depth int, content_sha256 string")


#: Fixed value: names of state files, with their rank and part.
PART = r"^states/.+-rank-(\d{5})-part-(\d{8})\.parquet$"


def footers(files: DataFrame, folder: str, tasks: int = 64) -> DataFrame:
    """(path, footer_rows, fields) of the Parquet files ``path`` below ``folder`` (a path or URI that every executor
    reaches); only footers are read. A file that can't be read has null in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            out: dict[str, list] = {"path": [], "footer_rows": [], "fields": []}
            for path in b.column(0).to_pylist():
                try:
                    with fs.open_input_file(f"{root}/{path}") as f:
                        m = pq.read_metadata(f)
                    rows, fields = m.num_rows, json.dumps([[x.name, str(x.type), x.nullable] for x in m.schema.to_arrow_schema()])
                except (OSError, pa.ArrowException):
                    rows = fields = None
                for name, v in zip(out, (path, rows, fields), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict({"path": pa.array(out["path"], pa.string()), "footer_rows": pa.array(out["footer_rows"], pa.int64()), "fields": pa.array(out["fields"], pa.string())})

    return files.select("path").repartition(tasks).mapInArrow(run, "path string, footer_rows long, fields string")


def audit_footers(files: DataFrame, folder: str, world: int, layer_counts: list[int], most_rows: int = 1_000_000) -> DataFrame:
    """(error, detail) of a manifest's files (path, rows or null) against their footers: names, ranks below ``world``, rows,
    one schema, parts of a rank numbered from 0 without a gap, and the sum of the layers."""
    read, _ = materialized(footers(files.select("path").distinct(), folder), "footers")
    named = F.regexp_extract("path", PART, 1)
    f = files.select("path", F.col("rows").cast("long").alias("rows")).join(read, "path").withColumn("rank", F.when(named != "", named.cast("int"))).withColumn("part", F.when(named != "", F.regexp_extract("path", PART, 2).cast("int")))
    say = lambda df, code, detail: df.select(F.lit(code).alias("error"), detail.cast("string").alias("detail"))
    path, none = F.col("path"), F.lit(None)
    out = say(f.where("rank IS NULL"), "FOOTER_PATH", path)
    out = out.unionByName(say(f.where(F.col("rank") >= world), "FOOTER_RANK", path))
    out = out.unionByName(say(f.where("footer_rows IS NULL"), "FOOTER_UNREADABLE", path))
    out = out.unionByName(say(f.where("rows <> footer_rows"), "FOOTER_FILE_ROWS", path))
    out = out.unionByName(say(f.agg(F.count("rows").alias("given"), F.count("*").alias("n")).where("given NOT IN (0, n)"), "FOOTER_FILE_ROWS_PARTIAL", none))
    out = out.unionByName(say(f.where(f"footer_rows NOT BETWEEN 1 AND {most_rows}"), "FOOTER_ROWS_PER_PART", path))
    out = out.unionByName(say(f.where("rank IS NOT NULL").groupBy("rank", "part").count().where("count > 1"), "FOOTER_DUPLICATE_PART", F.concat_ws("/", "rank", "part")))
    out = out.unionByName(say(f.agg(F.countDistinct("fields").alias("k")).where("k > 1"), "FOOTER_SCHEMA", none))
    out = out.unionByName(say(f.where("rank IS NOT NULL").groupBy("rank").agg(F.max("part").alias("last"), F.countDistinct("part").alias("k")).where("k <> last + 1"), "FOOTER_PART_SEQUENCE", F.col("rank")))
    return out.unionByName(say(f.agg(F.coalesce(F.sum("footer_rows"), F.lit(0)).alias("n")).where(F.col("n") != sum(layer_counts)), "FOOTER_ROW_TOTAL", F.col("n")))


def combine_ranks(receipts: DataFrame) -> DataFrame:
    """Rank receipts (rank, config_digest, layer_counts) of one run as (depth, states); RANK_SET or CONFIG if they disagree."""
    a = receipts.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("k"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("config_digest").alias("c")).first()
    if not (a.n == a.k == a.hi + 1 and a.lo == 0):
        raise ValueError("RANK_SET")
    if a.c != 1:
        raise ValueError("RANK_CONFIG")
    return receipts.select(F.posexplode("layer_counts").alias("depth", "n")).groupBy("depth").agg(F.sum("n").alias("states"))


def report(result: Layers) -> dict:
    return {"status": result.status, "reason": result.reason, "graph_digest": result.spec.digest(), "layer_sizes": result.sizes}


def write_receipts(result: Layers, folder: str) -> dict:
    """report.json and states.json in a new local folder of the driver. The last layer is there up to SAMPLE states, the
    one before it only if it has fewer; both are bounded before they are collected."""
    if os.path.exists(folder):
        raise FileExistsError(folder)
    os.makedirs(folder)
    last = result.completed_depth
    take = lambda d: [list(r.state) for r in result.layer(d).orderBy("state").limit(SAMPLE).collect()]
    small = take(last - 1) if last and last - 1 in result.frames and result.sizes[last - 1] < SAMPLE else []
    body = json.dumps({"schema": 2, "state_encoding": "int64", "current": take(last), "previous_small": small, "current_sample_limit": SAMPLE}, sort_keys=True).encode()
    out = report(result) | {"states_sha256": hashlib.sha256(body).hexdigest()}
    for name, data in (("states.json", body), ("report.json", json.dumps(out, sort_keys=True).encode())):
        with open(f"{folder}/{name}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}")
    return out


def read_receipts(folder: str) -> dict:
    with open(f"{folder}/report.json", "rb") as f:
        out = json.load(f)
    with open(f"{folder}/states.json", "rb") as f:
        body = f.read()
    if hashlib.sha256(body).hexdigest() != out["states_sha256"]:
        raise ValueError("GRAPH_RECEIPT_CHECKSUM")
    return out | json.loads(body)


def manifest_layers(spark: SparkSession, path: str) -> DataFrame:
    """All completed layers of tail manifests, those without retained states included."""
    schema = "status string, last_completed_layer int, stop_reason string, layers array<struct<depth:int,states:bigint,seconds:double,vram_peak_bytes:bigint>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("status", F.explode("layers").alias("l")).select("status", "l.*")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Cases of sweep ledgers, flat."""
    case = "struct<status:string,reason:string,last_completed_layer:int,attempted:boolean,n:int,r:int,backend:string,seconds:double>"
    return spark.read.schema(f"configuration string, cases map<string,{case}>").json(path, multiLine=True).select(F.explode("cases").alias("key", "c")).select("key", "c.*")


def sweep_timing(cases: DataFrame) -> DataFrame:
    return cases.groupBy("backend").agg(F.count("*").alias("cases"), F.count_if("attempted").alias("attempted"), F.sum(F.when(F.col("attempted"), F.col("seconds")).otherwise(0.0)).alias("seconds"))


def cohorts(cases: list[tuple[str, int, int]], most: int = 20, most_bytes: int = 2_000_000_000) -> list[list[str]]:
    """Cases (key, width, bytes) in order, grouped for shared files: equal widths, ``most`` cases, ``most_bytes`` (a larger
    case stands alone)."""
    out: list[list[str]] = []
    held, width_now = 0, None
    for key, width, size in cases:
        if out and width == width_now and len(out[-1]) < most and held + size <= most_bytes:
            out[-1].append(key)
            held += size
        else:
            out.append([key])
            held, width_now = size, width
    return out
