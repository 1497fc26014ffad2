"""Incremental ingest: changed files since the last run, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.hooks import Hooks
from loomgraph.operators.provenance import changed_files
from loomgraph.sources.code_parsers import parse_files
from loomgraph.sources.files import eligible, parser_kind

def parse_changed(indexed: DataFrame, files: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """Parsed rows of the files (path, checksum, content) that are new or changed against the index (path, checksum)."""
    hooks = hooks or Hooks()
    hooks.fire("before_ingest")
    fresh = changed_files(indexed, eligible(files))
    rows = parse_files(fresh.withColumn("kind", parser_kind("path", F.col("content").cast("string"))))
    hooks.fire("after_parse", rows)
    return rows


def stream(spark: SparkSession, folder: str, index_path: str, out_path: str, checkpoint: str):
    """A file stream whose micro-batches are parsed, written, and added to the index; starts and returns the query."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    files = source.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("path"), "content", F.sha2("content", 256).alias("checksum"))

    def batch(rows: DataFrame, number: int) -> None:
        empty = spark.createDataFrame([], "path string, checksum string")
        try:
            indexed = spark.read.schema("path string, checksum string").parquet(index_path)
            indexed.limit(1).count()
        except Exception:  # noqa: BLE001  the first batch finds no index
            indexed = empty
        fresh = changed_files(indexed, eligible(rows))
        parsed = parse_files(fresh.withColumn("kind", parser_kind("path", F.col("content").cast("string"))))
        # A batch that runs again after a failure writes to the same place.
        parsed.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        fresh.select("path", "checksum").write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
