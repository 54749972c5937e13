"""A training corpus from raw documents: toxicity, near copies, benchmark leaks, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerwise.llm import common, decontaminate, mixing, simhash, token_ids, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("simhash near-dedup", _near_copies),
    ("benchmark decontamination", _leaks),
    ("mixing sources", _mix),
    ("token ids", _token_ids),
]

#: The first stage is a trained model and the last a tokenizer and coder, so there is no SQL for the rows; tests/llm
#: holds each stage against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents. Rows that the mix takes twice are in the result twice."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
