"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed; for
every host the distinct texts that hold a line are counted, exact copies of a
text once, so that copies are left to deduplication.  A line is boilerplate on
a host when more than `line_docs` distinct texts and more than `line_percent`
per cent of the host's distinct texts hold it; on a small host more than
`few_docs` suffice at more than `few_percent` per cent, and on a large one more
than `many_docs` whatever their share (None switches either off).  Such lines
are removed, and a document is depleted when more than `depleted_percent` per
cent of its words went with them or fewer than `min_words` words are left.  Documents that fail the base rules (fewer than `min_words`
words, or more than `repeat_percent` per cent of the words inside repeated
three-word windows) are rejected as well.

One pass of vectorised Python turns each text into counts and line hashes; the
rest is DataFrame work.  Counting combines before its shuffle, and the join of
lines to boilerplate is a sort-merge join whose hot keys adaptive execution splits.

Cases: a null or empty text has no words and fails the base rules; a null host
is a host of its own; repeated rows and rows with equal or null ids are judged
each by itself; lines without a word are neither counted nor removed; an empty
table gives an empty table; extra columns are kept by the filter, and ignored
by the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import words
from loomgraph.llm.common import free_name, map_batches, materialise

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _line_hashes(chunk: words.Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines with a word, their number of words, hash of the normalised line)."""
    first = np.searchsorted(chunk.starts, starts)
    last = np.searchsorted(chunk.starts, ends)
    full = np.flatnonzero(last > first)
    acc = words._rolling(chunk.word_hashes(lower=True))
    return full, last[full] - first[full], words._spans(acc, first[full], last[full])


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Counts of each text, and its distinct line hashes with the words that they take up."""
    counts: dict[str, list[np.ndarray]] = {c: [] for c in _COUNTS}
    hashes, sizes = [], []
    for chunk in words.chunks(texts):
        raw = chunk.word_hashes(lower=False)
        points = words.code_points(chunk.data)
        counts["n_words"].append(chunk.counts)
        chars = np.concatenate([[0], np.cumsum(points[chunk.ends] - points[chunk.starts])])
        counts["word_chars"].append(chars[chunk.cuts[1:]] - chars[chunk.cuts[:-1]])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[chunk.data])])
        counts["n_symbols"].append(symbols[chunk.offsets[1:]] - symbols[chunk.offsets[:-1]])

        docs, starts, ends = chunk.lines()
        full, taken, normal = _line_hashes(chunk, starts, ends)
        docs = docs[full]
        exact = chunk.byte_spans(starts[full], ends[full])
        counts["n_dup_lines"].append(_repeats(docs, exact, chunk.n))

        at, windows = chunk.windows(raw, 3)
        of = np.searchsorted(chunk.cuts, at, side="right") - 1
        again = _in_repeats(of, windows)
        covered = np.zeros(len(raw) + 1, bool)
        for j in range(3):
            covered[at[again] + j] = True
        running = np.concatenate([[0], np.cumsum(covered)])
        counts["n_repeat_words"].append(running[chunk.cuts[1:]] - running[chunk.cuts[:-1]])

        order = np.lexsort((normal, docs))
        docs, normal, taken = docs[order], normal[order], taken[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (normal[1:] != normal[:-1])
        at = np.flatnonzero(new)
        taken = np.add.reduceat(taken, at) if len(at) else taken
        cuts = np.searchsorted(docs[at], np.arange(chunk.n + 1))
        hashes += [normal[at][cuts[i] : cuts[i + 1]] for i in range(chunk.n)]
        sizes += [taken[cuts[i] : cuts[i + 1]] for i in range(chunk.n)]
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in counts.items()}, hashes, sizes


def _in_repeats(docs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the value occurs more than once in its document."""
    key = words.mix(values + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _repeats(docs: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each document, values that equal an earlier one of it."""
    order = np.lexsort((values, docs))
    d, v = docs[order], values[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    return np.bincount(d[1:][same], minlength=n)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    cuts = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=cuts[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)).cast(kind))


def score(documents: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_words: int = 50, repeat_percent: int = 50, line_docs: int = 50, line_percent: float = 2.0, few_docs: int | None = 5, few_percent: float = 5.0, many_docs: int | None = 10_000, depleted_percent: int = 50) -> DataFrame:
    """One row per document row: id, host, text_key, the base counts, base_failed, removed_words, boilerplate (hashes), kept."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("key_a"), F.xxhash64(F.lit(1), text_col).alias("key_b"), F.col(text_col).alias("text"))
    kinds = dict(slim.dtypes)
    schema = f"doc_id {kinds['doc_id']}, host {kinds['host']}, key_a bigint, key_b bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", line_hash array<bigint>, line_words array<int>"

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, sizes = measure(batch.column(4))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *(pa.array(counts[c]) for c in _COUNTS), _lists(hashes, pa.int64()), _lists(sizes, pa.int32())],
            names=["doc_id", "host", "key_a", "key_b", *_COUNTS, "line_hash", "line_words"],
        )

    rows = materialise(map_batches(slim, scan, schema).withColumn("row", F.monotonically_increasing_id()))
    lines = rows.select("row", "host", "key_a", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("row", "host", "key_a", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("taken"))
    texts = rows.select("host", "key_a").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    n, size = F.col("n_docs"), F.col("host_docs")
    common = (n > line_docs) & (n * 100 > size * line_percent)
    if few_docs is not None:
        common |= (n > few_docs) & (n * 100 > size * few_percent)
    if many_docs is not None:
        common |= n > many_docs
    least = min(x for x in (line_docs, few_docs, many_docs) if x is not None)
    held = lines.select("host", "line", "key_a").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(n > least)
    boiler = held.join(texts, held["host"].eqNullSafe(texts["host"])).where(common).select(held["host"].alias("b_host"), F.col("line").alias("b_line"))
    removed = lines.join(boiler, (F.col("line") == F.col("b_line")) & F.col("host").eqNullSafe(F.col("b_host"))).groupBy("row").agg(F.sum("taken").cast("bigint").alias("removed_words"), F.sort_array(F.collect_list("line")).alias("boilerplate"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    gone = F.col("removed_words")
    depleted = (100 * gone > depleted_percent * F.col("n_words")) | ((gone > 0) & (F.col("n_words") - gone < min_words))
    return (
        rows.drop("line_hash", "line_words")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
        .withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<bigint>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .drop("row")
    )


def strip_lines(text: pa.Array, flagged: pa.ListArray) -> pa.Array:
    """Each text without the lines whose hash is flagged for it; unflagged texts stay as they are."""
    marks, cuts = flagged.values.to_numpy(zero_copy_only=False), flagged.offsets.to_numpy()
    out = []
    for chunk in words.chunks(text):
        docs, starts, ends = chunk.lines()
        full, _, normal = _line_hashes(chunk, starts, ends)
        keep = np.ones(len(docs), bool)
        edges = np.searchsorted(docs, np.arange(chunk.n + 1))
        for i in range(chunk.n):
            at = chunk.first + i
            own = marks[cuts[at] : cuts[at + 1]]
            if not len(own):
                out.append(text[at].as_py())
                continue
            a, b = np.searchsorted(full, edges[i]), np.searchsorted(full, edges[i + 1])
            keep[full[a:b]] = ~np.isin(words.signed(normal[a:b]), own)
            rows = np.flatnonzero(keep[edges[i] : edges[i + 1]]) + edges[i]
            out.append(b"\n".join(chunk.data[starts[r] : ends[r]].tobytes() for r in rows).decode("utf-8", "replace"))
    return pa.array(out, text.type)


def apply_rules(documents: DataFrame, *, host_col: str = "source", text_col: str = "text", chars_col: str = "n_chars", **limits) -> DataFrame:
    """The documents, all columns, that are kept, without their boilerplate lines; `chars_col`, if there, follows the text."""
    limits = {"host_col": host_col, "text_col": text_col, **limits}
    id_col = limits.pop("id_col", "doc_id")
    verdicts = score(documents, id_col=id_col, **limits)
    # A verdict depends on host and text alone, so one row of each decides for all copies.
    verdicts = verdicts.groupBy(F.col("host").alias("v_host"), F.col("key_a").alias("v_a"), F.col("key_b").alias("v_b")).agg(F.first("kept").alias("v_kept"), F.first("boilerplate").alias("v_lines"))
    changed = verdicts.where(~F.col("v_kept") | (F.size("v_lines") > 0))
    names = documents.columns
    joined = documents.join(
        changed,
        (F.xxhash64(documents[text_col]) == changed["v_a"]) & (F.xxhash64(F.lit(1), documents[text_col]) == changed["v_b"]) & documents[host_col].eqNullSafe(changed["v_host"]),
        "left",
    ).where(F.coalesce(changed["v_kept"], F.lit(True)))
    at, schema = names.index(text_col), documents.schema

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        flagged = columns.pop()
        if len(flagged.values):
            columns[at] = strip_lines(columns[at], flagged)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    flat = joined.select(*(documents[c] for c in names), F.coalesce(changed["v_lines"], F.array().cast("array<bigint>")).alias(free_name(documents, "lines")))
    out = map_batches(flat, strip, schema)
    return out.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType)) if chars_col in names else out
