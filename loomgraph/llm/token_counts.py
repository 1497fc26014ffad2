"""Token counts: the exact histogram of encoded lengths.

Documents are encoded whole on the executors and at once reduced to counts per
length, so only (group, length, count) is shuffled.  Suffix sums over that
histogram answer, for every context limit, how many documents and tokens there
are, how many are longer, and how many tokens stay if documents are truncated.
The sums run in two levels, inside bands of BAND lengths and over the bands'
totals, so no task holds a whole histogram however long documents get.

The vocabulary file is a parameter; the driver reads it and broadcasts it (a
vocabulary is of fixed size).

Cases: a null or empty text has length 0 and counts as a document; repeated
rows count each; null groups are a group; an empty table gives an empty
histogram; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's tokenizer splits texts before it merges bytes (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BAND = 1024

_encoders: dict[int, tiktoken.Encoding] = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a rank file's bytes; a Python worker makes it once."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_lengths(documents: DataFrame, *, text_col: str = "text", vocabulary_path: str = VOCABULARY, pattern: str = PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and n_tokens of each row."""
    with open(vocabulary_path, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())
    slim = documents.select(*keep, F.col(text_col))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(ranks.value, pattern).encode_ordinary
        lengths = np.fromiter((len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)), np.int64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths)], names=[*keep, "n_tokens"])

    kinds = dict(slim.dtypes)
    return map_batches(slim, count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"]))


def histogram(lengths: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group and n_tokens that occurs, with what holds for a context limit of n_tokens.

    n_docs have exactly this length, docs_longer are longer, docs_fitting and
    tokens_fitting are no longer; truncated_tokens remain if longer documents
    are cut at the limit; total_docs and total_tokens are those of the group.
    """
    counts = lengths.groupBy(*groups, "n_tokens").agg(F.count("*").alias("n_docs")).withColumn("band", F.expr(f"n_tokens div {BAND}"))
    counts = counts.withColumn("n_sum", F.col("n_docs") * F.col("n_tokens"))
    band = counts.groupBy(*groups, "band").agg(F.sum("n_docs").alias("b_docs"), F.sum("n_sum").alias("b_tokens"))
    whole = Window.partitionBy(*groups)
    after = whole.orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    band = band.select(
        *(F.col(g).alias(f"__{g}") for g in groups), F.col("band").alias("__band"),
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("b_docs").over(whole).alias("total_docs"), F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    same = F.col("band") == F.col("__band")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = Window.partitionBy(*groups, "band").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    counts = counts.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("tokens_in", F.coalesce(F.sum("n_sum").over(inside), F.lit(0)))
    longer, longer_tokens = F.col("docs_in") + F.col("docs_after"), F.col("tokens_in") + F.col("tokens_after")
    fitting = F.col("total_tokens") - longer_tokens
    return counts.join(band, same).select(
        *groups, "n_tokens", "n_docs", longer.alias("docs_longer"), (F.col("total_docs") - longer).alias("docs_fitting"), fitting.alias("tokens_fitting"), (fitting + longer * F.col("n_tokens")).alias("truncated_tokens"), "total_docs", "total_tokens"
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: docs_fitting, docs_longer and truncated_tokens of an ungrouped histogram, occurring length or not."""
    values = [
        F.struct(
            F.lit(limit).cast("bigint").alias("limit"), F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs"))), F.lit(0)).alias("docs_fitting"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_longer"), F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        )
        for limit in limits
    ]
    return hist.agg(F.array(*values).alias("v")).select(F.inline("v"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that this share of the documents does not exceed (null without documents)."""
    values = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_fitting") >= F.lit(float(q)) * F.col("total_docs"), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return hist.agg(F.array(*values).alias("v")).select(F.inline("v"))
