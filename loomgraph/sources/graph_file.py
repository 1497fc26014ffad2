"""Graph files: reading any of their forms, and the sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def alias(*names: str) -> Column:
    """The first of the fields that is there and not empty."""
    return F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON graph: with or without envelope, nodes as list or by id, edges or links, field aliases."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("v"))
    payload = F.coalesce(F.variant_get("v", "$.payload", "variant"), F.col("v"))
    graph = raw.select(payload.alias("g"))
    # variant_explode takes lists and objects alike.
    graph.createOrReplaceTempView(view := f"graph_{uuid.uuid4().hex}")
    text = lambda f: F.try_variant_get("value", f"$.{f}", "string").alias(f)
    nodes = spark.sql(f"SELECT e.key, e.pos, e.value FROM {view}, LATERAL variant_explode(variant_get(g, '$.nodes', 'variant')) e")
    nodes = nodes.select("key", "pos", *(text(f) for f in ("id", "rule_id", "type", "name", "description")), F.try_variant_get("value", "$.metadata", "string").alias("metadata"))
    nodes = nodes.select(F.coalesce(alias("id", "rule_id"), F.col("key")).alias("id"), "type", "name", "description", "metadata", F.col("pos").cast("bigint").alias("ord"))
    edges = spark.sql(f"SELECT e.pos, e.value FROM {view}, LATERAL variant_explode(coalesce(CASE WHEN cast(variant_get(g, '$.edges', 'variant') AS STRING) != '[]' THEN variant_get(g, '$.edges', 'variant') END, variant_get(g, '$.links', 'variant'))) e")
    edges = edges.select("pos", *(text(f) for f in ("source", "source_id", "target", "target_id", "relationship", "type")), F.try_variant_get("value", "$.confidence", "double").alias("confidence"))
    edges = edges.select(alias("source", "source_id").alias("source_id"), alias("target", "target_id").alias("target_id"), alias("relationship", "type").alias("relationship"), F.col("pos").cast("bigint").alias("ord"), "confidence")
    return nodes, edges


class GraphStore:
    """Versions of a graph in one folder: a write goes to a new version, then a pointer names it.

    Readers see whole versions only; a version that cannot be read is passed
    over for the one before.  Both tables are written before the pointer is, so
    a failed write leaves the old version in force.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> list[dict]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointers")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        rows = self.spark.read.schema("version long, name string").json(f"{self.root}/pointers").where("name is not null").orderBy(F.desc("version")).limit(10).collect()
        return [r.asDict() for r in rows]

    def save(self, nodes: DataFrame, edges: DataFrame) -> int:
        version = max([p["version"] for p in self._pointers()], default=0) + 1
        name = f"v{version}-{uuid.uuid4().hex[:8]}"
        nodes.write.parquet(f"{self.root}/{name}/nodes")
        edges.write.parquet(f"{self.root}/{name}/edges")
        self.spark.createDataFrame([(version, name)], "version long, name string").coalesce(1).write.mode("append").json(f"{self.root}/pointers")
        return version

    def load(self) -> tuple[DataFrame, DataFrame]:
        for pointer in self._pointers():
            try:
                place = f"{self.root}/{pointer['name']}"
                return self.spark.read.parquet(f"{place}/nodes"), self.spark.read.parquet(f"{place}/edges")
            except Exception as problem:  # noqa: BLE001  the version before is the rescue
                last = problem
        raise FileNotFoundError(f"no readable version in {self.root}") from (last if self._pointers() else None)


def to_node_link(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph of bounded size (for export to other tools) as one JSON text."""
    rows = lambda df: [json.loads(r) for r in df.toJSON().collect()]
    return json.dumps({"nodes": rows(nodes.orderBy("id")), "edges": rows(edges.orderBy("source_id", "target_id"))}, sort_keys=True)


def write_csv(rows: DataFrame, path: str) -> None:
    """Minimal quoting, doubled quotes, LF line ends."""
    rows.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("lineSep", "\n").option("emptyValue", "").csv(path)


def migrate(graph: dict, version: int) -> dict:
    """Old envelopes step by step: version 1 called the edges links."""
    if version < 2 and "links" in graph and "edges" not in graph:
        graph = {**{k: v for k, v in graph.items() if k != "links"}, "edges": graph["links"]}
    return graph
