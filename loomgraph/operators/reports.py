"""Breakdowns, drift reports and views of a graph for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import truncated

SEVERITIES = ("info", "warning", "critical")
COLOURS = {"business_rule": "#e8a33d", "test_scenario": "#4f9d69", "api_endpoint": "#4a7fb5", "product_feature": "#8b6bb1"}


def breakdown(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) with a last row for the total (key null)."""
    return rows.rollup(key).agg(F.count("*").alias("n"))


def normal_anomalies(anomalies: DataFrame) -> DataFrame:
    """Old records in the present form: kind, severity and summary have defaults."""
    return anomalies.select(
        "node_id",
        F.coalesce("anomaly_kind", F.lit("legacy_requirement_drift")).alias("anomaly_kind"),
        F.coalesce("severity", F.lit("info")).alias("severity"),
        F.substring(F.coalesce("summary", "observed_deviation_profile", F.lit("")), 1, 200).alias("summary"),
    )


def drift_report(anomalies: DataFrame, edges: DataFrame) -> DataFrame:
    """(facet, value, n): records by kind and by severity, and the total with the DRIFTED_FROM edges."""
    a = normal_anomalies(anomalies)
    sets = a.groupingSets([[F.col("anomaly_kind")], [F.col("severity")]], F.col("anomaly_kind"), F.col("severity")).agg(F.count("*").alias("n"), F.grouping("anomaly_kind").alias("g"))
    facets = sets.select(F.when(F.col("g") == 0, "kind").otherwise("severity").alias("facet"), F.coalesce("anomaly_kind", "severity").alias("value"), "n")
    drifted = edges.where("relationship = 'DRIFTED_FROM'").select(F.lit(1))
    total = a.select(F.lit(1)).unionAll(drifted).agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit("all").alias("value"), "n")
    return facets.unionByName(total)


def anomalies_by_feature(anomalies: DataFrame, parents: DataFrame) -> DataFrame:
    """(feature_id, kinds, one count for each severity) from anomalies and (node_id, feature_id)."""
    joined = normal_anomalies(anomalies).join(parents, "node_id")
    kinds = joined.groupBy("feature_id", "anomaly_kind").agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return kinds.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("anomaly_kind", "n"))).alias("kinds"), *(F.sum(s).alias(s) for s in SEVERITIES))


def diagram(nodes: DataFrame) -> DataFrame:
    """Nodes with labels cut to 22 characters if above 25, and a colour for their type."""
    colours = F.create_map(*(F.lit(x) for p in COLOURS.items() for x in p))
    return nodes.select("id", truncated("name", 25, 22).alias("label"), F.coalesce(F.element_at(colours, F.col("type")), F.lit("#999999")).alias("colour"))


def rule_index(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'business_rule'").select("id", "name", "description")


def type_buckets(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row: the sorted ids of each type."""
    return nodes.agg(*(F.array_sort(F.collect_set(F.when(F.col("type") == k, F.col("id")))).alias(k) for k in kinds))


def not_placeholder(nodes: DataFrame) -> DataFrame:
    origin = F.coalesce("origin", F.lit("")) if "origin" in nodes.columns else F.lit("")
    return nodes.where((origin != "placeholder") & ~F.lower("name").startswith("placeholder"))


def rules_for_query(rules: DataFrame, words: list[str]) -> DataFrame:
    """(feature_id, hits, total): features ranked by rules that name one of the words; `*` takes all rules."""
    if words == ["*"]:
        hit = F.lit(True)
    else:
        text = F.lower(F.concat_ws(" ", "name", "description"))
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w.lower()))
    return rules.where(hit).groupBy("feature_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "feature_id")


def anomaly_flags(rules: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(id, anomaly_flags): the different kinds of each rule's anomalies (node_id, anomaly_kind), in order; without any, an empty list."""
    kinds = anomalies.where("anomaly_kind != ''").groupBy(F.col("node_id").alias("k_id")).agg(F.array_sort(F.collect_set("anomaly_kind")).alias("anomaly_flags"))
    return rules.select("id").join(kinds, F.col("id") == F.col("k_id"), "left").select("id", F.coalesce("anomaly_flags", F.array().cast("array<string>")).alias("anomaly_flags"))


def anomalies_of_severity(anomalies: DataFrame, severity: str | None = None) -> DataFrame:
    """The anomalies of a severity, given in any case; without one, all."""
    wanted = (severity or "").strip().lower()
    return anomalies.where(F.col("severity") == wanted) if wanted else anomalies
