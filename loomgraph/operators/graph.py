"""Graph queries over nodes(id, type, ..) and edges(source_id, target_id, relationship, ord, confidence)."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.functions.shared import free_name, materialise
from loomgraph.plans.schema import TRAVERSABLE

#: Up to so many ids, counted, are broadcast; beyond, they are joined by a shuffle.
FEW = 500_000


def written(df: DataFrame) -> DataFrame:
    """Rows written to the folder that all executors share, and read back: a cut of the lineage."""
    return materialise(df, "graph")


def _counted(ids: DataFrame) -> DataFrame:
    """Written ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def find_nodes(nodes: DataFrame, query: str = "", kind: str | None = None) -> DataFrame:
    """Nodes of a type whose name, description or metadata contains the query, whatever its case."""
    if kind:
        nodes = nodes.where(F.col("type") == kind)
    if query:
        q = query.lower()
        fields = [c for c in ("name", "description", "metadata") if c in nodes.columns]
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
        nodes = nodes.where(hit)
    return nodes


def find_edges(edges: DataFrame, source_id: str | None = None, target_id: str | None = None) -> DataFrame:
    if source_id is not None:
        edges = edges.where(F.col("source_id") == source_id)
    return edges if target_id is None else edges.where(F.col("target_id") == target_id)


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id).limit(1)


def existing_edges(edges: DataFrame, wanted: DataFrame, negate: bool = False) -> DataFrame:
    """Of wanted (source_id, target_id, relationship), those that exist (or do not), relationships in any case."""
    have = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.upper("relationship").alias("r"))
    same = (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t")) & (F.upper("relationship") == F.col("r"))
    return wanted.join(have, same, "left_anti" if negate else "left_semi")


def edges_by_source(edges: DataFrame, source: str, limit: int = 100) -> DataFrame:
    """Edges whose provenance is `source` or starts with `source:`, in order."""
    hit = (F.col("source") == source) | F.col("source").startswith(source + ":")
    return edges.where(hit).orderBy("ord").limit(limit)


def last_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair, the last one written."""
    last = Window.partitionBy("source_id", "target_id").orderBy(F.col("ord").desc(), F.col("relationship").desc(), F.col("confidence").desc())
    return edges.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def rooted_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes; the ends that are not are found first, so that edges meet these only."""
    lost = _unknown(edges, nodes)
    whole = edges.where("source_id is not null and target_id is not null")
    return whole.join(lost, F.col("source_id") == F.col("id"), "left_anti").join(lost, F.col("target_id") == F.col("id"), "left_anti")


def _unknown(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends of edges that are no node, without null."""
    return _counted(written(dangling_ends(edges, nodes).where("id is not null")))


class MissingEnds(ValueError):
    """Edges whose ends are no nodes were to be refused with an error."""


def split_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends among the nodes, the others with missing_source and missing_target)."""
    lost = _unknown(edges, nodes)
    s, t = lost.select(F.col("id").alias("s_id")), lost.select(F.col("id").alias("t_id"))
    checked = edges.join(s, F.col("source_id") == F.col("s_id"), "left").join(t, F.col("target_id") == F.col("t_id"), "left")
    missing = lambda end, found: F.col(end).isNull() | F.col(found).isNotNull()
    checked = checked.withColumn("missing_source", missing("source_id", "s_id")).withColumn("missing_target", missing("target_id", "t_id")).drop("s_id", "t_id")
    bad = F.col("missing_source") | F.col("missing_target")
    return checked.where(~bad).drop("missing_source", "missing_target"), checked.where(bad)


def upsert_edges(edges: DataFrame, incoming: DataFrame, nodes: DataFrame, missing: str = "warn") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(edges after the incoming ones, those refused, counts) of edges (source_id, target_id, relationship, ord, confidence).

    Relationships are put in upper case and the last edge of a pair stays; edges
    of unknown ends are refused.  missing='warn' logs how many, 'raise' raises
    MissingEnds with some of them, 'silent' only counts.  One pass checks, writes
    and counts (accepted, refused).
    """
    if missing not in ("warn", "raise", "silent"):
        raise ValueError("missing is warn, raise or silent")
    ids = nodes.select("id").where("id is not null").distinct()
    s, t = ids.select(F.col("id").alias("s_id")), ids.select(F.col("id").alias("t_id"))
    checked = incoming.withColumn("relationship", F.upper("relationship")).join(s, F.col("source_id") == F.col("s_id"), "left").join(t, F.col("target_id") == F.col("t_id"), "left")
    checked = checked.withColumn("missing_source", F.col("s_id").isNull()).withColumn("missing_target", F.col("t_id").isNull()).drop("s_id", "t_id")
    bad = F.col("missing_source") | F.col("missing_target")
    seen = Observation(f"edges-{uuid.uuid4().hex}")
    rows = written(checked.observe(seen, F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("refused")))
    counts = seen.get
    refused = rows.where(bad)
    if counts["refused"] and missing == "raise":
        some = [f"{r.source_id} {r.relationship} {r.target_id}" for r in refused.select("source_id", "relationship", "target_id").limit(5).collect()]
        raise MissingEnds(f"{counts['refused']} edges have unknown ends: {', '.join(some)}")
    if counts["refused"] and missing == "warn":
        logging.getLogger(__name__).warning("%d edges have unknown ends", counts["refused"])
    return last_edges(edges.unionByName(rows.where(~bad).select(*edges.columns))), refused, counts


def dangling_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends of edges that are no node."""
    ends = edges.select(F.col("source_id").alias("id")).unionAll(edges.select("target_id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def undirected(edges: DataFrame, floor: float = 0.0) -> DataFrame:
    """(a, b, confidence) both ways; a missing confidence is 1; of an edge and its reverse the last one counts."""
    c = F.coalesce("confidence", F.lit(1.0))
    kept = edges.where(c >= floor).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), c.alias("confidence"), "ord")
    one = kept.groupBy("a", "b").agg(F.max_by("confidence", F.struct("ord", "confidence")).alias("confidence"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))


def around(edges: DataFrame, ids: DataFrame, floor: float = 0.0) -> DataFrame:
    """(id): the other ends of the ids' edges at or above the floor, either way."""
    kept = edges.where(F.coalesce("confidence", F.lit(1.0)) >= floor).select("source_id", "target_id")
    here = ids.select(F.col("id").alias("here"))
    out = kept.join(here, F.col("source_id") == F.col("here")).select(F.col("target_id").alias("id"))
    back = kept.join(here, F.col("target_id") == F.col("here")).select(F.col("source_id").alias("id"))
    return out.unionAll(back).distinct()


def neighbourhood(edges: DataFrame, nodes: DataFrame, root: str, depth: int = 2, max_nodes: int = 80, floor: float = 0.0) -> DataFrame:
    """(id, depth, confidence): the root and what is within `depth` undirected steps, the best `max_nodes` of it.

    The frontier is a DataFrame that is written each step; ranking is by the
    greatest confidence of an edge inside the visited set, then by id.
    """
    visited = nodes.where(F.col("id") == root).select("id").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for step in range(1, depth + 1):
        # Only edges that touch the frontier are shuffled further; a frontier that has been counted as small shuffles no edges.
        reached = around(edges, _counted(frontier), floor)
        frontier = written(reached.join(visited, "id", "left_anti").join(nodes.select("id"), "id", "left_semi").withColumn("depth", F.lit(step)))
        visited = visited.unionByName(frontier)
    inside = undirected(induced_edges(edges, visited), floor)
    best = inside.groupBy("a").agg(F.max("confidence").alias("confidence"))
    ranked = visited.join(best, F.col("id") == F.col("a"), "left").select("id", "depth", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return ranked.orderBy((F.col("id") != root).cast("int"), F.col("confidence").desc(), "id").limit(max_nodes)


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges among the ids (a DataFrame with a column id)."""
    ids = ids.select("id").distinct()
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def reachable(edges: DataFrame, seeds: DataFrame, relationships: tuple[str, ...] = TRAVERSABLE, both_ways: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """(id): all that the seeds reach over the relationships; ids that are no node are reached but not left."""
    steps = edges.where(F.upper("relationship").isin(*relationships)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    if both_ways:
        steps = steps.unionAll(steps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    visited = frontier = written(seeds.select("id").distinct())
    # Equal steps are left in: what they lead to is made distinct anyway, and that costs less than all steps in every turn.
    while n := frontier.count():
        leaving = frontier if nodes is None else written(nodes.select("id").join(F.broadcast(frontier) if n <= FEW else frontier, "id", "left_semi").distinct())
        leaving = F.broadcast(leaving) if n <= FEW else leaving
        frontier = written(steps.join(leaving.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(visited, "id", "left_anti"))
        visited = visited.unionAll(frontier)
    return visited


def dirty_closure(edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """The dirty ids and their direct neighbours."""
    d = dirty.select("id").distinct()
    out = edges.join(d, F.col("source_id") == F.col("id")).select(F.col("target_id").alias("n"))
    back = edges.join(d, F.col("target_id") == F.col("id")).select(F.col("source_id").alias("n"))
    return d.unionAll(out).unionAll(back).distinct()


def rule_peers(edges: DataFrame, nodes: DataFrame, family: tuple[str, ...]) -> DataFrame:
    """(id, peers): for each node of the family its MAPS_TO neighbours of the family, either way, sorted."""
    maps = edges.where("relationship = 'MAPS_TO' AND source_id != target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    ways = maps.unionAll(maps.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rules = nodes.where(F.col("type").isin(*family)).select("id")
    held = ways.join(rules, F.col("a") == F.col("id"), "left_semi").join(rules, F.col("b") == F.col("id"), "left_semi")
    return held.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("peers"))


def extended_context(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, buckets: dict[tuple[str, str], str]) -> DataFrame:
    """(seed, bucket, other): the other ends of the seeds' edges, put into buckets by (relationship, type of the other)."""
    s = seeds.select(F.col("id").alias("seed"))
    out = edges.join(s, F.col("source_id") == F.col("seed")).select("seed", F.col("target_id").alias("other"), "relationship")
    back = edges.join(s, F.col("target_id") == F.col("seed")).select("seed", F.col("source_id").alias("other"), "relationship")
    typed = out.unionAll(back).join(nodes.select("id", "type"), F.col("other") == F.col("id"))
    bucket: Column = F.lit(None).cast("string")
    for (relationship, kind), name in buckets.items():
        bucket = F.when((F.col("relationship") == relationship) & (F.col("type") == kind), name).otherwise(bucket)
    return typed.select("seed", bucket.alias("bucket"), "other").where("bucket is not null").distinct()


def dominant(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; the first seen wins ties."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(key, value, "n")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of nodes and edges without the ids."""
    g = gone.select("id").distinct()
    left = nodes.join(g, "id", "left_anti")
    return left, edges.join(g, F.col("source_id") == F.col("id"), "left_anti").join(g, F.col("target_id") == F.col("id"), "left_anti")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: errors, warnings, is_valid and counts of a graph file's tables (type and ids may be missing)."""
    kind = F.lower(F.coalesce("type", F.lit("unknown")))
    stats = nodes.agg(
        F.count("*").alias("total_nodes"), F.count_if(kind == "business_rule").alias("business_rule_count"), F.count_if(kind == "test_scenario").alias("scenarios"), F.count_if(kind == "api_endpoint").alias("endpoints"), F.count_if(F.col("id").isNull()).alias("missing_ids")
    )
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lines = edges.agg(
        F.count("*").alias("edge_count"), F.count_if(F.upper("relationship").isin(*TRAVERSABLE)).alias("traversable_edge_count"), F.count_if(absent("source_id")).alias("no_source"), F.count_if(absent("target_id")).alias("no_target"), F.count_if(absent("relationship")).alias("no_relationship")
    )
    whole = edges.where(~absent("source_id") & ~absent("target_id"))
    lost = dangling_ends(whole, nodes.where("id is not null"))
    # The preview is the feature: five ids, taken as a top-k.
    preview = lost.orderBy("id").limit(5).agg(F.array_sort(F.collect_list("id")).alias("dangling_preview"))
    row = stats.crossJoin(lines).crossJoin(lost.agg(F.count("*").alias("dangling"))).crossJoin(preview)  # single rows
    row = row.withColumn("dangling", F.when(F.col("total_nodes") > F.col("missing_ids"), F.col("dangling")).otherwise(0))
    say = lambda when, text: F.when(when, text)
    errors = F.array_compact(F.array(say(F.col("business_rule_count") == 0, "no business rule"), say(F.col("missing_ids") > 0, "nodes without id"), say(F.col("no_source") > 0, "edges without source"), say(F.col("no_target") > 0, "edges without target"), say(F.col("no_relationship") > 0, "edges without relationship"), say(F.col("dangling") > 0, "dangling ends")))
    warnings = F.array_compact(F.array(say(F.col("scenarios") == 0, "no scenario"), say(F.col("endpoints") == 0, "no endpoint"), say((F.col("edge_count") > 0) & (F.col("traversable_edge_count") == 0), "nothing traversable")))
    return row.select("total_nodes", "business_rule_count", "edge_count", "traversable_edge_count", "missing_ids", "dangling", "dangling_preview", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("is_valid"))
