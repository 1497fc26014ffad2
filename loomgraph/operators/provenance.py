"""Which file gave which node and edge, and what follows when files change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_report(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): synced, modified, new or deleted, from two tables (path, checksum)."""
    a = indexed.select(F.col("path").alias("p"), F.col("checksum").alias("old"), F.lit(True).alias("was"))
    b = found.select(F.col("path").alias("q"), F.col("checksum").alias("new"), F.lit(True).alias("there"))
    both = a.join(b, F.col("p") == F.col("q"), "full_outer")
    status = F.when(F.col("there").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "synced").otherwise("modified")
    return both.select(F.coalesce("p", "q").alias("path"), status.alias("status"))


def changed_files(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """The found files (all columns) that are new or have another checksum."""
    return found.join(indexed.select("path", "checksum"), ["path", "checksum"], "left_anti")


def deleted_files(indexed: DataFrame, found: DataFrame) -> DataFrame:
    return indexed.join(found.select("path"), "path", "left_anti")


def forget(claims: DataFrame, files: DataFrame, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(what is left of the claims (file, key), keys that no file claims any more)."""
    gone = files.select("file").distinct()
    left = claims.join(gone, "file", "left_anti")
    orphans = claims.join(gone, "file", "left_semi").select(key).distinct().join(left.select(key), key, "left_anti")
    return left, orphans


def record(claims: DataFrame, fresh: DataFrame) -> DataFrame:
    """Claims of re-parsed files replaced by the fresh ones."""
    return claims.join(fresh.select("file").distinct(), "file", "left_anti").unionByName(fresh.select(*claims.columns))


def untracked(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    return nodes.select("id").join(claims.select(F.col("node_id").alias("id")), "id", "left_anti")


def files_of(claims: DataFrame, key: str = "node_id") -> DataFrame:
    return claims.groupBy(key).agg(F.array_sort(F.collect_set("file")).alias("files"))


def bootstrap(nodes: DataFrame) -> DataFrame:
    """Claims (file, node_id) from the nodes' own source files."""
    return nodes.where("source_file is not null").select(F.col("source_file").alias("file"), F.col("id").alias("node_id")).distinct()
