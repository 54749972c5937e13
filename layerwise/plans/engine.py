"""One call from a graph to its result: bounds, lane, search, receipts. Covers BF11, BF12, FL5-FL8, FL17, SM3, 2.14."""

from __future__ import annotations

import argparse
import contextlib
import json
import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions import bounds, planning, states
from ..operators import membership, search
from ..sources import families, store
from .spec import GraphSpec, from_json, from_object


LANES = ("auto", "driver", "packed", "hybrid", "array")


def _count(v, least: int, most: float, code: str) -> None:
    if v is not None and (type(v) is not int or not least <= v <= most):
        raise ValueError(code)


@dataclass(frozen=True)
class Options:
    """Checked on creation; the codes name the option."""

    lane: str = "auto"
    max_seconds: int | None = None  # None and 0 are no limit
    max_layers: int | None = None
    capacity: int | None = None
    retain: int | None = 3
    membership: str = "aggregate"
    candidate_order: str = "none"
    shards: int | None = None
    owner_page: int | None = None

    def __post_init__(self) -> None:
        if self.lane not in LANES:
            raise ValueError("INVALID_LANE")
        if self.membership not in membership.WAYS:
            raise ValueError("INVALID_MEMBERSHIP")
        if self.candidate_order not in ("none", "radix"):
            raise ValueError("INVALID_CANDIDATE_ORDER")
        planning.work_seconds(self.max_seconds)
        for name, most in (("max_layers", math.inf), ("capacity", (1 << 64) - 1), ("retain", math.inf), ("shards", 4096)):
            _count(getattr(self, name), 1, most, f"INVALID_{name.upper()}")
        _count(self.owner_page, 0, 1 << 20, "INVALID_OWNER_PAGE")
        if self.owner_page and self.owner_page & (self.owner_page - 1):
            raise ValueError("INVALID_OWNER_PAGE")
        # options that only make sense together
        if self.owner_page and self.membership != "bitmap":
            raise ValueError("OWNER_PAGE_REQUIRES_BITMAP")
        if self.candidate_order != "none" and self.lane not in ("auto", "array"):
            raise ValueError("CANDIDATE_ORDER_REQUIRES_ARRAY_LANE")


def unsupported(options: dict) -> str | None:
    """The first option that isn't known."""
    return next((k for k in options if k not in Options.__dataclass_fields__), None)


def unsupported_result(options: dict, **defaults) -> str | None:
    """The first option of a result that asks for anything but its default; start states are always taken."""
    return next((k for k, v in options.items() if k != "start_states" and (k not in defaults or v != defaults[k])), None)


def plan(spec: GraphSpec) -> dict:
    """What a search would do: bounds, lane, history, partitions."""
    bound = bounds.orbit_bound(spec)
    bits = states.bits_of(spec)
    closed = spec.inverse_closed()
    lane = "driver" if bound is not None and bound <= search.DRIVER_STATES else "hybrid" if bits and closed else "packed" if bits else "array"
    return {"digest": spec.digest(), "bounds": bounds.orbit_bounds(spec), "lane": lane, "bits": bits, "history": "rolling" if closed else "full", "partitions": bounds.partitions(bound or 1 << 40)}


def run_graph(spark: SparkSession, graph, output: str | None = None, cancelled=lambda: False, on_layer=None, **options) -> search.Layers:
    """Search a GraphSpec, its JSON, a label, or a graph object; with ``output`` also write the receipts."""
    if name := unsupported(options):
        raise TypeError(name)
    o = Options(**options)
    spec = graph if isinstance(graph, GraphSpec) else (from_json(graph) if graph.lstrip().startswith("{") else families.from_label(graph)) if isinstance(graph, str) else from_object(graph)
    if o.membership != "aggregate" or o.candidate_order != "none":
        rank = states.orbit_rank("state", spec) if o.membership == "bitmap" else None
        sizes = membership.layers_by(spark, spec, o.membership, rank=rank, order=o.candidate_order)
        return search.Layers(spec, spark, None, sizes)
    result = search.layers(spark, spec, lane=o.lane, retain=o.retain, maximum_states=o.capacity, max_layers=o.max_layers, max_seconds=planning.work_seconds(o.max_seconds), cancelled=cancelled, on_layer=on_layer)
    if output:
        store.write_receipts(result, output)
    return result


def same_prefix(a: search.Layers, b: search.Layers) -> bool:
    """Whether two searches agree on the layers that both have whole."""
    n = min(len(a.sizes), len(b.sizes))
    return a.sizes[:n] == b.sizes[:n]


@contextlib.contextmanager
def jobs(spark: SparkSession) -> Iterator[str]:
    """Jobs of a search under one group, cancelled together if the block is left by an error."""
    group = f"search-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "graph search", interruptOnCancel=True)
    try:
        yield group
    except BaseException:
        spark.sparkContext.cancelJobGroup(group)
        raise
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Session:
    """Numbered searches on one Spark session. A search that fails poisons it: what it left behind isn't known, so later
    ones are refused; ``cancel`` stops the one that runs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.job, self.phase, self.poisoned, self._stop = spark, 0, "idle", False, False

    def run(self, graph, **options) -> search.Layers:
        if self.poisoned:
            raise RuntimeError("SESSION_POISONED")
        if self.phase != "idle":
            raise RuntimeError("SESSION_BUSY")
        self.job, self.phase, self._stop = self.job + 1, "bfs", False
        try:
            with jobs(self.spark):
                return run_graph(self.spark, graph, cancelled=lambda: self._stop, **options)
        except BaseException:
            self.poisoned = True
            raise
        finally:
            self.phase = "idle"

    def cancel(self) -> None:
        self._stop = True


def main(args: list[str] | None = None) -> int:
    """python -m layerwise.plans.engine graph|plan|verify LABEL_OR_FILE"""
    p = argparse.ArgumentParser(prog="layerwise")
    p.add_argument("verb", choices=("graph", "plan", "verify"))
    p.add_argument("what", help="a label such as s8, u3m4 or lrx8r2, a JSON file, or a folder of receipts")
    p.add_argument("--output")
    p.add_argument("--max-layers", type=int)
    a = p.parse_args(args)
    if a.verb == "verify":
        print(json.dumps({"status": store.read_receipts(a.what)["status"]}))
        return 0
    if a.what.endswith(".json"):
        with open(a.what) as f:
            spec = from_json(f.read())
    else:
        spec = families.from_label(a.what)
    if a.verb == "plan":
        print(json.dumps(plan(spec)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(store.report(run_graph(spark, spec, a.output, max_layers=a.max_layers))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
