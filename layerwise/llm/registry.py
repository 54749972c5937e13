"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, licenses, mixing, secrets, simhash, token_ids, toxicity, url_filter, vector_graph


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_token_ids": token_ids.op1_token_ids,
        "op2_secrets": secrets.op2_secrets,
        "op3_vector_graph": vector_graph.op3_vector_graph,
        "op4_simhash": simhash.op4_simhash,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_language": language.op6_language,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_licenses": licenses.op8_licenses,
        "op9_mixing": mixing.op9_mixing,
        "op10_toxicity": toxicity.op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op3_vector_graph": vector_graph.SQL, "op7_url_filter": url_filter.SQL, "op9_mixing": mixing.SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
