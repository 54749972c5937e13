"""Layers that arrive over time. A producer writes layer=<d> folders and then one commit row; nothing of a layer is visible
before its commit. Covers SM1, SM2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "depth int, states bigint"


def publish(layer: DataFrame, folder: str, depth: int, states: int) -> None:
    """Write a layer and then its commit."""
    layer.write.mode("overwrite").parquet(f"{folder}/layers/depth={depth}")
    layer.sparkSession.createDataFrame([(depth, states)], COMMITS).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def consume(spark: SparkSession, folder: str, target: str, checkpoint: str) -> DataFrame:
    """Copy committed layers to ``target`` by a file stream of commits; each once, by depth, however often a batch is
    tried again: a layer's folder is overwritten. Returns the layers that are there: (depth, states)."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select("depth", "states").distinct().collect():  # as many rows as new layers
            layer = spark.read.parquet(f"{folder}/layers/depth={row.depth}")
            if layer.count() != row.states:
                raise ValueError("ARCHIVE_LAYER_COUNT")
            layer.write.mode("overwrite").parquet(f"{target}/depth={row.depth}")

    commits = spark.readStream.schema(COMMITS).parquet(f"{folder}/commits")
    q = commits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target).groupBy("depth").agg(F.count("*").alias("states"))
