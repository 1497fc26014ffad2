"""URL filters: a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path
starts with the rule's.  The trie is walked along the labels from the right; in
the deepest host node that has a fitting rule, the longest path wins; a block
entry wins over an equal allow entry.  URLs that no rule fits get the default.

The trie is broadcast up to MAX_RULES rules.  Larger rule sets are joined
instead: a URL is exploded to its host suffixes and path prefixes (a few dozen
keys, whatever the rules), which meet rules by equality.

Cases: a null URL, or one without `://`, has an empty host and path (only a
rule with an empty host and path can fit); repeated rows are judged each;
null ids are kept; an empty table gives an empty table; without rules all get
the default; other columns are kept by filter_urls() and ignored by judge().
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import free_name, map_batches

#: Rules that may be broadcast (some 200 bytes each).
MAX_RULES = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


class Trie:
    """Nodes are dicts of labels; under ENTRIES a host node holds its path trie, a path node its tails."""

    ENTRIES = None

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in sorted(set(rules), key=lambda r: r.verdict == "block"):
            node = self.root
            for label in reversed(rule.host.split(".") if rule.host else []):
                node = node.setdefault(label, {})
            node = node.setdefault(self.ENTRIES, {})
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(self.ENTRIES, {})[tail] = rule

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, self._in_path(self.root, path)
        for label in reversed(host.split(".") if host else []):
            node = node.get(label)
            if node is None:
                break
            best = self._in_path(node, path) or best
        return best

    def _in_path(self, node: dict, path: str) -> Rule | None:
        node = node.get(self.ENTRIES)
        best = None
        for segment in path.split("/"):
            if node is None:
                break
            fits = [t for t in node.get(self.ENTRIES, ()) if segment.startswith(t)]
            if fits:
                best = node[self.ENTRIES][max(fits, key=len)]
            node = node.get(segment)
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page row: the id, host, path, rule (host and path, or null) and verdict.

    `rules` may be a table with columns host, path and verdict; more than
    MAX_RULES of either kind are joined.
    """
    host, path = host_and_path(F.col(url_col))
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    slim = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select(*(F.coalesce(c, F.lit("")).alias(c) for c in Rule._fields)).distinct()
        if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
            return _judge_by_join(slim, rules, id_col, default)
        rules = [Rule(*r) for r in rules.toLocalIterator()]
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [trie.value.find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        names = pa.array([r and r.host + r.path for r in found], pa.string())
        verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, names, verdicts], names=[*batch.schema.names, "rule", "verdict"])

    return map_batches(slim, run, f"`{id_col}` {slim.dtypes[0][1]}, host string, path string, rule string, verdict string")


def _judge_by_join(slim: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same verdicts, for rule sets that are too large to broadcast."""
    head = lambda path: F.coalesce(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.lit(""))  # noqa: E731  up to the last slash
    table = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), F.xxhash64("host", head(F.col("path"))).alias("r_key"))
    urls = slim.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    heads = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))))
    keys = urls.withColumn("suffix", F.explode(suffixes)).withColumn("head", F.explode(heads)).withColumn("key", F.xxhash64("suffix", "head"))
    fits = keys.join(table, (F.col("key") == F.col("r_key")) & (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), (F.col("r_verdict") == "block").alias("c"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("m"))
    best = best.select(F.col("host").alias("m_host"), F.col("path").alias("m_path"), "m.rule", "m.verdict")
    joined = slim.join(best, (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")), "left")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The pages, all columns, whose verdict is allow; for more than MAX_RULES rules join judge()'s verdicts instead."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules are not broadcast; judge() joins them")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    host, path = host_and_path(F.col(url_col))
    wide = pages.select("*", host.alias(free_name(pages, "u_host")), path.alias(free_name(pages, "u_path")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [trie.value.find(h, p) for h, p in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        keep = pa.array([(r.verdict if r else default) == "allow" for r in found], pa.bool_())
        return pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(keep)

    return map_batches(wide, run, pages.schema)
