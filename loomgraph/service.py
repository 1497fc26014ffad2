"""The operators as calls on a workspace, each answered by an envelope {ok, data, error}.

Answers are of bounded size (top-k, breakdowns, capped searches); whole tables
stay DataFrames, at `nodes` and `edges`.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import coverage, graph, merge, reports, search
from loomgraph.operators.provenance import sync_report
from loomgraph.sources.graph_file import GraphStore

CODES = ("WORKSPACE_NOT_FOUND", "NODE_NOT_FOUND", "INVALID_PATH", "PATH_TRAVERSAL", "VALIDATION_ERROR", "INTERNAL_ERROR", "NO_CANDIDATES", "LOCK_TIMEOUT", "SHARD_NOT_FOUND", "INVALID_STRATEGY")


@dataclass
class Fault(Exception):
    code: str
    message: str
    hint: str | None = None


def enveloped(call: Callable) -> Callable:
    @wraps(call)
    def answer(*args, **kwargs) -> dict:
        try:
            return {"ok": True, "data": call(*args, **kwargs), "error": None}
        except Fault as fault:
            return {"ok": False, "data": None, "error": asdict(fault)}
        except Exception as problem:  # noqa: BLE001  a call never raises
            return {"ok": False, "data": None, "error": asdict(Fault("INTERNAL_ERROR", str(problem)[:500]))}

    return answer


def inside(candidate: str, root: str) -> str:
    """The real path of a candidate, which must not leave the root."""
    base = os.path.realpath(root)
    place = os.path.realpath(os.path.join(base, candidate))
    if os.path.commonpath([base, place]) != base:
        raise Fault("PATH_TRAVERSAL", f"{candidate} is outside the workspace")
    return place


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Workspace:
    """A graph and the calls on it."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, store: GraphStore | None = None):
        self.nodes, self.edges, self.store = nodes, edges, store

    def _known(self, node_id: str) -> None:
        if not graph.get_node(self.nodes, node_id).count():
            raise Fault("NODE_NOT_FOUND", f"no node {node_id}", "search for it by name")

    @enveloped
    def summary(self) -> dict:
        return {"nodes": _rows(reports.breakdown(self.nodes, "type")), "edges": _rows(reports.breakdown(self.edges, "relationship"))}

    @enveloped
    def search(self, query: str, kind: str | None = None) -> list[dict]:
        return _rows(search.search(self.nodes, query, kind).select("id", "type", "name", "score"))

    @enveloped
    def trace(self, node_id: str, depth: int = 2, max_nodes: int = 80, floor: float = 0.0) -> dict:
        self._known(node_id)
        around = graph.written(graph.neighbourhood(self.edges, self.nodes, node_id, depth, max_nodes + 1, floor))
        found = around.count()
        kept = around.orderBy((F.col("id") != node_id).cast("int"), F.col("confidence").desc(), "id").limit(max_nodes)
        return {"nodes": _rows(kept), "edges": _rows(graph.induced_edges(self.edges, kept)), "truncated": found > max_nodes}

    @enveloped
    def drift(self, anomalies: DataFrame) -> list[dict]:
        return _rows(reports.drift_report(anomalies, self.edges))

    @enveloped
    def validate(self) -> dict:
        return _rows(graph.validate(self.nodes, self.edges))[0]

    @enveloped
    def features(self) -> list[dict]:
        return _rows(coverage.features_with_counts(self.nodes, self.edges))

    @enveloped
    def add_edge(self, source_id: str, target_id: str, relationship: str, confidence: float = 1.0) -> dict:
        self._known(source_id)
        self._known(target_id)
        number = (self.edges.agg(F.max("ord")).head()[0] or 0) + 1
        one = self.edges.sparkSession.createDataFrame([(source_id, target_id, relationship, number, confidence)], "source_id string, target_id string, relationship string, ord long, confidence double")
        self.edges = graph.last_edges(self.edges.select(*one.columns).unionAll(one))
        return {"source_id": source_id, "target_id": target_id}

    @enveloped
    def propose(self, proposals: DataFrame, floor: float = 0.6) -> dict:
        screened = merge.screen_proposals(proposals, self.nodes, floor)
        counts = {r["reason"] or "accepted": r["n"] for r in screened.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        number = self.edges.agg(F.max("ord")).head()[0] or 0
        fresh = screened.where("reason is null").select("source_id", "target_id", "relationship", F.lit(number + 1).cast("long").alias("ord"), "confidence")
        self.edges = graph.last_edges(self.edges.select(*fresh.columns).unionAll(fresh))
        return counts

    @enveloped
    def sync(self, indexed: DataFrame, found: DataFrame) -> dict:
        return {r["status"]: r["n"] for r in sync_report(indexed, found).groupBy("status").agg(F.count("*").alias("n")).collect()}

    @enveloped
    def save(self) -> int:
        if self.store is None:
            raise Fault("WORKSPACE_NOT_FOUND", "this workspace has no store")
        return self.store.save(self.nodes, self.edges)


class Registry:
    """Workspaces by real path; the first one is the default."""

    def __init__(self, spark: SparkSession):
        self.spark, self._by_path = spark, {}

    def add(self, path: str, workspace: Workspace) -> None:
        self._by_path[os.path.realpath(path)] = workspace

    def get(self, path: str | None = None) -> Workspace:
        if path is None and self._by_path:
            return next(iter(self._by_path.values()))
        found = self._by_path.get(os.path.realpath(path)) if path else None
        if found is None:
            raise Fault("WORKSPACE_NOT_FOUND", f"no workspace {path}")
        return found
