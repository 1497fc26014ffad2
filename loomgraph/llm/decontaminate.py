"""Benchmark decontamination: short test items found inside long documents.

Method: size-partitioned MinHash containment search, then exact verification.
Items are dealt into classes by the power of two below their shingle count.
Every class has its own MinHash depth: the smallest hashes of an item, one more
than the shingles that may be missing at the threshold for the largest item of
the class.  A document that contains enough of an item must hold at least one
of them (pigeonhole), so probing whole documents with the sketches loses
nothing; banded signatures of whole documents would, because the Jaccard
similarity of 40 words to 20,000 is about 0.002.  Candidates are verified by
exact containment of the item's shingle set.

The search is one pass over the documents without a shuffle: sketches are
broadcast in blocks of bounded size, and a benchmark of several blocks takes
one pass for each.

Cases: a null or empty text on either side has no shingles and matches nothing;
an item of fewer than `k` words is one shingle (its whole word sequence) and
matches every document that holds these words in a row; equal items under several ids
give a row for each; a repeated row gives its matches again; null ids are kept;
empty tables give no rows; other columns are ignored by the search and passed
through by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import words
from loomgraph.llm.common import map_batches

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20


class Sketches:
    """MinHash sketches and shingle sets of a block of items."""

    def __init__(self, ids: pa.Array, texts: pa.Array, k: int, percent: int):
        self.k, self.percent, self.sets, rows = k, percent, [], []
        sketch, owner = [], []
        #: word counts of the items of fewer than k words
        self.short: set[int] = set()
        with np.errstate(over="ignore"):
            for chunk in words.chunks(texts):
                cuts, values = chunk.shingles(chunk.word_hashes(lower=True), k)
                for i in range(chunk.n):
                    own = values[cuts[i] : cuts[i + 1]]
                    if not len(own):
                        continue
                    largest = 2 ** int(len(own)).bit_length() - 1  # of the item's size class
                    depth = min(len(own), largest * (100 - percent) // 100 + 1)
                    sketch.append(own[:depth])  # sorted, so these are the smallest
                    owner.append(np.full(depth, len(self.sets)))
                    rows.append(chunk.first + i)
                    if chunk.counts[i] < k:
                        self.short.add(int(chunk.counts[i]))
                    self.sets.append(own)
        self.ids = ids.take(pa.array(rows, pa.int64()))
        self.values = np.concatenate(sketch) if sketch else np.zeros(0, np.uint64)
        order = np.argsort(self.values, kind="stable")
        self.values = self.values[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        #: a first sieve by the leading 20 bits
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.values >> np.uint64(44)] = True

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, its shingles, shared) for each text and item that it contains."""
        for chunk in words.chunks(texts):
            hashes = chunk.word_hashes(lower=True)
            # A short item is one window of its own length.
            at, values = (np.concatenate(x) for x in zip(*(chunk.windows(hashes, n) for n in (self.k, *sorted(self.short))), strict=True))
            docs = np.searchsorted(chunk.cuts, at, side="right") - 1
            hits = np.flatnonzero(self.sieve[values >> np.uint64(44)])
            low = np.searchsorted(self.values, values[hits], side="left")
            high = np.searchsorted(self.values, values[hits], side="right")
            pairs = sorted({(int(docs[h]), int(self.owner[j])) for h, a, b in zip(hits, low, high, strict=True) for j in range(a, b)})
            have, of = None, -1
            for doc, item in pairs:
                if doc != of:
                    have, of = np.unique(values[docs == doc]), doc
                own = self.sets[item]
                where = np.minimum(np.searchsorted(have, own), len(have) - 1)
                shared = int((have[where] == own).sum())
                if 100 * shared >= self.percent * len(own):
                    yield chunk.first + doc, item, len(own), shared


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, k: int, percent: int) -> Iterator[Sketches]:
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    total = items.select(F.sum(F.octet_length("t") + 16)).head()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").toArrow()
        yield Sketches(part.column("i").combine_chunks(), part.column("t").combine_chunks(), k, percent)


def containment_search(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document row and item of which it contains `percent` or more of the shingles.

    Columns: the two ids, item_shingles, shared (long) and containment (shared / item_shingles).
    """
    kinds = documents.select(id_col).dtypes[0][1], benchmark.select(item_col).dtypes[0][1]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, item_shingles bigint, shared bigint, containment double"
    slim = documents.select(F.col(id_col), F.col(text_col))
    out = None
    for sketches in _blocks(benchmark, item_col, item_text_col, k, percent):
        block = documents.sparkSession.sparkContext.broadcast(sketches)

        def find(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
            found = list(block.value.search(batch.column(1)))
            rows, items, sizes, shared = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), block.value.ids.take(pa.array(items)), pa.array(sizes), pa.array(shared), pa.array(shared / np.maximum(sizes, 1))],
                names=[id_col, item_col, "item_shingles", "shared", "containment"],
            )

        part = map_batches(slim, find, schema)
        out = part if out is None else out.unionAll(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that contain no item; the same search as containment_search()."""
    schema, at = documents.schema, documents.columns.index(text_col)
    for sketches in _blocks(benchmark, item_col, item_text_col, k, percent):
        block = documents.sparkSession.sparkContext.broadcast(sketches)

        def keep(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in block.value.search(batch.column(at))]] = False
            return batch.filter(pa.array(clean))

        documents = map_batches(documents, keep, schema)
    return documents
