"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shared import free_name, materialise, shared_dir  # noqa: F401  the operators' helpers
from loomgraph.functions.shipping import ship

#: One word: a run of characters outside blank, tab, LF, VT, FF and CR (a fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with this package on the workers and wrapping integer arithmetic."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from f(batches)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """map_arrow with one function from a batch to a batch."""
    return map_arrow(df, lambda batches: (out for batch in batches if (out := f(batch)).num_rows), schema)


def give_back() -> None:
    """Return what a Python worker has freed to the machine, for a worker that stays has it otherwise until its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def repeated(documents: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether any id and text come in more than one row."""
    keys = documents.groupBy(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body")).agg(F.count("*").alias("n"))
    return keys.where("n > 1").limit(1).count() > 0
