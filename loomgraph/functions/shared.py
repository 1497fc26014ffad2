"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master that names no shared folder, as in tests.
FALLBACK_CHECKPOINT_DIR = "/tmp/loomgraph-checkpoints"

_owner: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on a cluster it must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return FALLBACK_CHECKPOINT_DIR


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    files, place = _place(spark, path)
    files.deleteOnExit(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it is not there."""
    files, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def materialise(df: DataFrame, name: str = "loomgraph") -> DataFrame:
    """Write rows to the shared folder as Parquet and read them back.

    Cuts the lineage like checkpoint(), so values such as row numbers stay fixed
    when a task is run again after a lost executor, and is columnar and compressed.
    The table goes at the end of its scope(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(place)
    owner = _owner.get()
    if owner is not None:
        owner.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What materialise() writes inside, by this thread, goes at the end; results read from it must be saved first."""
    owned: list[str] = []
    before = _owner.set(owned)
    try:
        yield
    finally:
        _owner.reset(before)
        for path in owned:
            delete(spark, path)


def free_name(df: DataFrame, wish: str) -> str:
    """The wish, or the next name like it that no column of the table has."""
    taken, name, n = {c.lower() for c in df.columns}, wish, 0
    while name.lower() in taken:
        n += 1
        name = f"{wish}_{n}"
    return name
