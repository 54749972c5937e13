"""What a queue does with duplicates when a vertex is claimed before it is queued, or settled when it is taken out.

The order of a queue is one sequence by definition, so this is a simulation on the driver of a graph that
``search.driver_graph`` admits. Covers ST8; occurrences per depth are ``analytics.walk_counts``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import materialized
from .search import Csr, driver_graph


def simulated(g: Csr, source: int, claim: bool) -> dict:
    """enqueued, expanded, stale (taken out after they were settled), peak (longest queue) and the depths."""
    depth = np.full(len(g.vertices), -1, np.int64)
    waiting, enqueued, expanded, stale, peak = deque([(source, 0)]), 1, 0, 0, 1
    if claim:
        depth[source] = 0
    while waiting:
        at, d = waiting.popleft()
        if not claim:
            if depth[at] >= 0:
                stale += 1
                continue
            depth[at] = d
        expanded += 1
        for to in g.to[g.start[at] : g.start[at + 1]].tolist():
            if depth[to] >= 0:
                continue
            if claim:
                depth[to] = d + 1
            waiting.append((to, d + 1))
            enqueued += 1
            peak = max(peak, len(waiting))
    return {"enqueued": enqueued, "expanded": expanded, "stale": stale, "peak": peak, "depths": depth}


def queue_statistics(spark: SparkSession, edges: DataFrame, source: int) -> DataFrame:
    """(rule, enqueued, expanded, stale, peak, settled, farthest) of both rules."""
    arcs, n = materialized(edges.select("src", "dst").distinct(), "arcs")
    g = driver_graph(arcs, n, spark.createDataFrame([(source,)], "vertex long"))
    if g is None:
        raise ValueError("QUEUE_GRAPH_SIZE")
    rows = []
    for rule in ("claim_before_enqueue", "settle_on_dequeue"):
        r = simulated(g, int(g.place(np.array([source]))[0]), rule.startswith("claim"))
        rows.append((rule, r["enqueued"], r["expanded"], r["stale"], r["peak"], int((r["depths"] >= 0).sum()), int(r["depths"].max())))
    return spark.createDataFrame(rows, "rule string, enqueued long, expanded long, stale long, peak long, settled long, farthest long")
