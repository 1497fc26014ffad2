"""The relational tables as nodes, edges, texts and files of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, prefix: str, kind: str, key: str, name: str, description) -> DataFrame:
    return df.select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("type"), F.col(name).cast("string").alias("name"), description.cast("string").alias("description"), F.col(key).cast("bigint").alias("ord"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, description, ord."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        _node(t("region"), "region_", "region", "r_regionkey", "r_name", F.lit("")),
        _node(t("nation"), "nation_", "nation", "n_nationkey", "n_name", F.lit("")),
        _node(t("customer"), "customer_", "customer", "c_custkey", "c_name", F.col("c_mktsegment")),
        _node(t("supplier"), "supplier_", "supplier", "s_suppkey", "s_name", F.lit("")),
        _node(t("part"), "part_", "part", "p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type")),
        _node(t("orders"), "order_", "order", "o_orderkey", "o_orderstatus", F.col("o_orderpriority")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, source, target, kind: str, order, confidence=None) -> DataFrame:
    return df.select(
        F.concat(F.lit(source[0]), F.col(source[1])).alias("source_id"), F.concat(F.lit(target[0]), F.col(target[1])).alias("target_id"), F.lit(kind).alias("relationship"), order.cast("bigint").alias("ord"), (F.lit(1.0) if confidence is None else confidence).alias("confidence")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, relationship, ord, confidence; a multigraph, as the order lines make it."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return (
        _edge(t("nation"), ("nation_", "n_nationkey"), ("region_", "n_regionkey"), "PART_OF", F.col("n_nationkey"))
        .unionByName(_edge(t("customer"), ("customer_", "c_custkey"), ("nation_", "c_nationkey"), "MAPS_TO", F.col("c_custkey")))
        .unionByName(_edge(t("supplier"), ("supplier_", "s_suppkey"), ("nation_", "s_nationkey"), "REFERENCES", F.col("s_suppkey")))
        .unionByName(_edge(t("orders"), ("order_", "o_orderkey"), ("customer_", "o_custkey"), "TESTS", F.col("o_orderkey")))
        .unionByName(_edge(line, ("order_", "l_orderkey"), ("part_", "l_partkey"), "VALIDATES", F.col("ord"), 1 - F.col("l_discount")))
        .unionByName(_edge(line, ("part_", "l_partkey"), ("supplier_", "l_suppkey"), "CALLS", F.col("ord"), 1 - F.col("l_discount")))
    )


# The same, in SQL: a prefix for WITH clauses.
NODES_SQL = """nodes AS (
SELECT 'region_' || r_regionkey AS id, 'region' AS type, r_name AS name, '' AS description, r_regionkey::BIGINT AS ord FROM region
UNION ALL SELECT 'nation_' || n_nationkey, 'nation', n_name, '', n_nationkey::BIGINT FROM nation
UNION ALL SELECT 'customer_' || c_custkey, 'customer', c_name, c_mktsegment, c_custkey FROM customer
UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier', s_name, '', s_suppkey FROM supplier
UNION ALL SELECT 'part_' || p_partkey, 'part', p_name, p_brand || ' ' || p_type, p_partkey FROM part
UNION ALL SELECT 'order_' || o_orderkey, 'order', o_orderstatus, o_orderpriority, o_orderkey FROM orders)"""
EDGES_SQL = """edges AS (
SELECT 'nation_' || n_nationkey AS source_id, 'region_' || n_regionkey AS target_id, 'PART_OF' AS relationship, n_nationkey::BIGINT AS ord, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'MAPS_TO', c_custkey, 1.0 FROM customer
UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'REFERENCES', s_suppkey, 1.0 FROM supplier
UNION ALL SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 'TESTS', o_orderkey, 1.0 FROM orders
UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey, 'VALIDATES', l_orderkey * 10 + l_linenumber, 1 - l_discount FROM lineitem
UNION ALL SELECT 'part_' || l_partkey, 'supplier_' || l_suppkey, 'CALLS', l_orderkey * 10 + l_linenumber, 1 - l_discount FROM lineitem)"""
