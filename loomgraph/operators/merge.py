"""Writes to the graph: upserts, governance, anomalies and endpoint deduplication.

A batch of incoming nodes is folded per id in its order by aggregates that
combine before their shuffle (see fold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import normal_path
from loomgraph.operators import fold
from loomgraph.plans.schema import CATEGORY_TYPES, RULE_FAMILY

#: Documents that carry the say over a node.
DOCUMENT_EXTENSIONS = ("docx", "pdf", "xlsx", "csv", "md", "feature")


def normal_types(nodes: DataFrame) -> DataFrame:
    """Category types become business_rule with a rule_category; family types carry rule_family."""
    category = F.col("type").isin(*CATEGORY_TYPES)
    return nodes.withColumn("rule_category", F.when(category, F.col("type"))).withColumn("type", F.when(category, "business_rule").otherwise(F.col("type"))).withColumn("rule_family", F.when(F.col("type").isin(*RULE_FAMILY), "business_rule"))


def origin_of(path: str = "source_file") -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin(*DOCUMENT_EXTENSIONS), "documentation").otherwise("code")


def governed(updates: DataFrame) -> DataFrame:
    """normal_types(), with rule_category and rule_family in the metadata (JSON) too, where the latter is not given already."""
    out = normal_types(updates)
    given = F.coalesce(F.from_json("metadata", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    added = F.map_filter(F.create_map(F.lit("rule_category"), F.col("rule_category"), F.lit("rule_family"), F.when((F.col("type") != "business_rule") & ~F.array_contains(F.map_keys(given), "rule_family"), F.col("rule_family"))), lambda k, v: v.isNotNull())
    kept = F.map_filter(given, lambda k, v: (k != "rule_category") | F.col("rule_category").isNull())
    return out.withColumn("metadata", F.to_json(F.map_concat(kept, F.transform_values(added, lambda k, v: F.parse_json(F.concat(F.lit('"'), v, F.lit('"')))))))


def upsert_nodes(updates: DataFrame) -> DataFrame:
    """Fold updates (id, ord, type, name, description, metadata, origin, source_file, caller) into one row for each id.

    Metadata are a JSON object, whose objects merge one level deep, or a map of
    strings; they come out in the same form.  In order: an agent's update of a
    node of documentation origin is only an anomaly, the rest is as fold says.
    anomalies are the first 200 characters of what agents were kept from saying,
    once each, in order.
    """
    flat = dict(updates.dtypes)["metadata"] != "string"
    taken, kept_out = fold.accepted(updates)
    nodes = fold.nodes_of(fold.combine(fold.pieces_of(taken), nested=not flat), flat)
    said = kept_out.groupBy(F.col("id").alias("a_id"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("said")).agg(F.min("ord").alias("ord"))
    said = said.groupBy("a_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "said"))), lambda x: x["said"]).alias("anomalies"))
    return nodes.join(said, F.col("id").eqNullSafe(F.col("a_id")), "left").drop("a_id").withColumn("anomalies", F.coalesce("anomalies", F.array().cast("array<string>")))


def record_anomalies(anomalies: DataFrame) -> DataFrame:
    """One of each node, kind and summary (its first 200 characters): the first one."""
    first = Window.partitionBy("node_id", "anomaly_kind", F.substring(F.coalesce("summary", F.lit("")), 1, 200)).orderBy("ord")
    return anomalies.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def resolve_drift(nodes: DataFrame, edges: DataFrame, node_id: str, description: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A node's anomalies cleared, its description replaced if one is given, and its incoming DRIFTED_FROM edges removed."""
    here = F.col("id") == node_id
    if description is not None:
        nodes = nodes.withColumn("description", F.when(here, F.lit(description)).otherwise(F.col("description")))
    nodes = nodes.withColumn("anomalies", F.when(here, F.array().cast(nodes.schema["anomalies"].dataType)).otherwise(F.col("anomalies")))
    return nodes, edges.where(~((F.col("target_id") == node_id) & (F.col("relationship") == "DRIFTED_FROM")))


def duplicate_endpoints(endpoints: DataFrame) -> DataFrame:
    """(id, primary, key): endpoints (id, path, http_method, has_spec, ord) that share method and normalised path.

    The primary is the first with a specification, or else the one with the shortest id.
    """
    key = F.concat_ws(" ", F.upper(F.coalesce("http_method", F.lit("GET"))), normal_path("path"))
    rows = endpoints.withColumn("key", key)
    group = Window.partitionBy("key")
    spec = F.max("has_spec").over(group)
    rows = rows.withColumn("size", F.count("*").over(group)).withColumn("any_spec", spec)
    rank = F.row_number().over(group.orderBy(F.col("has_spec").desc(), F.when(F.col("any_spec"), F.col("ord")), F.when(~F.col("any_spec"), F.length("id")), "ord", "id"))
    rows = rows.withColumn("rank", rank).where("size > 1")
    return rows.withColumn("primary", F.first("id").over(group.orderBy("rank"))).select("id", "primary", "key")


def merge_endpoints(endpoints: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(id, description, n_merged): each primary with the longest description of its group."""
    joined = endpoints.select("id", "description", "ord").join(duplicates.select("id", "primary"), "id")
    return joined.groupBy("primary").agg(F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"), F.count("*").alias("n_merged")).withColumnRenamed("primary", "id")


def rewire(edges: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Edges with duplicate ends replaced by their primaries; loops that this makes go."""
    m = duplicates.where("id != primary").select("id", "primary")
    s, t = m.select(F.col("id").alias("s"), F.col("primary").alias("sp")), m.select(F.col("id").alias("t"), F.col("primary").alias("tp"))
    out = edges.join(s, F.col("source_id") == F.col("s"), "left").join(t, F.col("target_id") == F.col("t"), "left")
    moved = out.withColumn("loop", (F.col("s").isNotNull() | F.col("t").isNotNull()) & (F.coalesce("sp", "source_id") == F.coalesce("tp", "target_id")))
    return moved.where(~F.col("loop")).withColumn("source_id", F.coalesce("sp", "source_id")).withColumn("target_id", F.coalesce("tp", "target_id")).select(*edges.columns)


def screen_proposals(proposals: DataFrame, nodes: DataFrame, floor: float = 0.6) -> DataFrame:
    """Proposed edges with a reason to reject them, or null: no relationship, low confidence, no source, no target."""
    ids = nodes.select(F.col("id")).distinct()
    s, t = ids.withColumnRenamed("id", "s"), ids.withColumnRenamed("id", "t")
    joined = proposals.join(s, F.col("source_id") == F.col("s"), "left").join(t, F.col("target_id") == F.col("t"), "left")
    reason = F.when(F.col("relationship").isNull(), "no relationship").when(F.col("confidence") < floor, "low confidence").when(F.col("s").isNull(), "no source").when(F.col("t").isNull(), "no target")
    return joined.withColumn("reason", reason).drop("s", "t")
