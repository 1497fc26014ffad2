"""Parts of a workspace that are read apart and merged into one graph.

A shard is what the files of some patterns say (see ingest.facts): pieces of
nodes, edges, words and errors, each with its file, in a folder of its own.  As
facts of different files go together in any order, shards merge by a union, in
whatever order they were read, into the graph that one build of all files gives.
A file that several shards have read counts once, from the first that is named.
"""

from __future__ import annotations

import datetime
import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.shared import children, delete, exists
from loomgraph.operators import graph
from loomgraph.plans import ingest
from loomgraph.plans.state import OF_FILES, State, take_in
from loomgraph.sources.files import eligible

STARTED = "shard_id string, started_at timestamp"
FINISHED = "shard_id string, status string, completed_at timestamp, file_count bigint, error string"


def matches(path: str, patterns: list[str]) -> Column:
    """Whether a path matches any of the shell patterns, whose `*` stands for folders too."""
    shape = "|".join(re.sub(r"\\[zZ]$", "", fnmatch.translate(p.lstrip("/"))) for p in patterns)
    return F.col(path).rlike(rf"^(?:{shape})\z") if patterns else F.lit(False)


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def ingest_shard(files: DataFrame, root: str, shard_id: str, include: list[str], exclude: list[str] | None = None) -> dict[str, int]:
    """Read the files (path, checksum, content) that match (without patterns: all) and none to leave out; a failure is recorded and raised."""
    spark, place = files.sparkSession, f"{root.rstrip('/')}/{shard_id}"
    if not re.fullmatch(r"[A-Za-z0-9_-]+", shard_id):
        raise ValueError("a shard is named by letters, digits, - and _")
    delete(spark, place)
    spark.createDataFrame([(shard_id, _now())], STARTED).coalesce(1).write.parquet(f"{place}/started")
    try:
        own = eligible(files).where((matches("path", include) if include else F.lit(True)) & ~matches("path", exclude or [])).select("path", "checksum", "content")
        said = ingest.facts(own.select("path", "content"))
        for name in OF_FILES:
            said[name].write.parquet(f"{place}/{name}")
        own.select("path", "checksum").write.parquet(f"{place}/files")
        read = lambda name: spark.read.parquet(f"{place}/{name}")
        counts = {"parsed_files": read("files").count(), "error_files": read("errors").select("file").distinct().count(), "total_nodes": read("pieces").select("id").distinct().count(), "total_edges": read("edges").count()}
    except Exception as problem:
        spark.createDataFrame([(shard_id, "failed", _now(), 0, str(problem)[:500])], FINISHED).coalesce(1).write.mode("overwrite").parquet(f"{place}/finished")
        raise
    spark.createDataFrame([(shard_id, "completed", _now(), counts["parsed_files"], None)], FINISHED).coalesce(1).write.parquet(f"{place}/finished")
    return counts


def list_shards(spark: SparkSession, root: str, hours: int = 24) -> list[dict]:
    """Each shard with its status: completed, failed, running, stale (running for more than `hours`) or unknown."""
    out = []
    for shard_id in children(spark, root):
        place = f"{root.rstrip('/')}/{shard_id}"
        row = {"shard_id": shard_id, "status": "unknown", "started_at": None, "completed_at": None, "file_count": 0}
        if exists(spark, f"{place}/started"):
            row["started_at"] = spark.read.schema(STARTED).parquet(f"{place}/started").head().started_at
            old = spark.read.schema(STARTED).parquet(f"{place}/started").where(F.col("started_at") < F.current_timestamp() - F.expr(f"INTERVAL {hours} HOURS")).count()
            row["status"] = "stale" if old else "running"
        if exists(spark, f"{place}/finished"):
            row |= spark.read.schema(FINISHED).parquet(f"{place}/finished").select("status", "completed_at", "file_count").head().asDict()
        out.append(row)
    return out


def clear_shards(spark: SparkSession, root: str, shard_ids: list[str] | None = None, hours: int = 24) -> list[str]:
    """Delete the named shards, or else those that are stale, failed or unknown; returns their names."""
    gone = shard_ids if shard_ids is not None else [s["shard_id"] for s in list_shards(spark, root, hours) if s["status"] in ("stale", "failed", "unknown")]
    for shard_id in gone:
        delete(spark, f"{root.rstrip('/')}/{shard_id}")
    return gone


def facts_of(spark: SparkSession, root: str, shard_ids: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(files (path, checksum), facts) of shards together."""
    def of(name: str) -> DataFrame:
        out = None
        for n, shard_id in enumerate(shard_ids):
            rows = spark.read.parquet(f"{root.rstrip('/')}/{shard_id}/{name}").withColumn("shard", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return out

    files = of("files").groupBy("path").agg(F.min_by("checksum", "shard").alias("checksum"), F.min("shard").alias("shard"))
    own = files.select(F.col("path").alias("file"), "shard")
    return files.drop("shard"), {name: of(name).join(own, ["file", "shard"], "left_semi").drop("shard") for name in OF_FILES}


def merge_shards(spark: SparkSession, root: str, shard_ids: list[str], folder: str) -> dict[str, object]:
    """Take completed shards into the graph kept in a folder (see state), as one batch; they are deleted then, others are named as failed."""
    status = {s["shard_id"]: s["status"] for s in list_shards(spark, root)}
    good, failed = [i for i in dict.fromkeys(shard_ids) if status.get(i) == "completed"], [i for i in dict.fromkeys(shard_ids) if status.get(i) != "completed"]
    counts: dict[str, object] = {"shards_merged": len(good), "shards_failed": failed}
    if not good:
        return counts
    files, said = facts_of(spark, root, good)
    counts |= take_in(State(spark, folder), said, graph.written(files.withColumn("gone", F.lit(False))))
    clear_shards(spark, root, good)
    return counts
