"""Plans that cut a set of files into shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import shard_name

FAMILIES = {
    "docs": ("md", "docx", "pdf", "txt", "rst"), "spreadsheets": ("xlsx", "csv", "xls"), "java": ("java",), "typescript": ("ts", "tsx", "js", "jsx"),
    "python": ("py",), "go": ("go",), "features": ("feature",), "schemas": ("yaml", "yml", "json"),
}


def by_directory(files: DataFrame) -> DataFrame:
    """(shard, n_files, n_bytes) by top directory of (path, size)."""
    top = F.when(F.contains("path", F.lit("/")), F.get(F.split("path", "/"), 0)).otherwise("root")
    return files.groupBy(shard_name(top).alias("shard")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def by_format(files: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for family, exts in FAMILIES.items() for e in exts for x in (e, family)))
    family = F.element_at(kinds, F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    return files.where(F.contains("path", F.lit("/"))).groupBy(family.alias("shard")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes")).where("shard is not null")


def pack(sizes: list[tuple[str, int]], bins: int) -> dict[str, int]:
    """Names to bins: the largest first, each to the lightest bin, lowest number on ties."""
    heap = [(0, i) for i in range(max(1, min(bins, len(sizes))))]
    out = {}
    for name, size in sorted(sizes, key=lambda x: -x[1]):
        load, i = heapq.heappop(heap)
        out[name] = i
        heapq.heappush(heap, (load + size, i))
    return out


def merge_smallest(shards: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """(name, n_files) with the two of the fewest files merged until `most` are left."""
    heap = [(n, i, name) for i, (name, n) in enumerate(shards)]
    heapq.heapify(heap)
    at = len(heap)
    while len(heap) > max(1, most):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], at, f"{a[2]}_and_{b[2]}"))
        at += 1
    return [(name, n) for n, _, name in sorted(heap)]
