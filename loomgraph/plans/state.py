"""A graph that is kept in a folder and follows its files, batch by batch.

Each batch adds one partition, `batch=n`, to a few Parquet tables and changes
none that are there; the table of files is written last and commits the batch.
A batch that failed is overwritten by the next one, which takes its number.

| Table | One row for each | Is in force while |
| --- | --- | --- |
| files | file that a batch parsed or lost (path, checksum, gone) | no later batch has the file |
| pieces, edges, words, errors | fact of a file (see ingest.facts) | its file's row is |
| dirty | node whose files changed (id) | always |
| nodes | dirty node that is still there | no later batch has the node dirty |
| weights | term of such a node, under the IDF of the first batch | the same |
| scored | pair of alike nodes, of which one was dirty | no later batch has either node dirty |

So a batch reads the text of changed files only, folds changed nodes only, and
compares changed nodes with all others, by the stored weights; nodes that no
file claims any more are gone with their edges.  The IDF is that of the first
batch, unknown terms counting as in no document, so that a pair's score does not
depend on when its nodes came; fit_again() moves to the present IDF.

One writer at a time; readers see committed batches only.  Null contents are
files that were deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.hooks import Hooks
from loomgraph.functions.shared import exists, scope
from loomgraph.operators import graph, linking, similarity
from loomgraph.plans import ingest
from loomgraph.plans.schema import CANDIDATE
from loomgraph.sources.files import eligible

OF_FILES = ("pieces", "edges", "words", "errors")


class State:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.batch = -1
        if exists(spark, f"{self.folder}/files"):
            self.batch = self.spark.read.parquet(f"{self.folder}/files").agg(F.max("batch")).head()[0]

    def table(self, name: str) -> DataFrame:
        """All committed rows."""
        return self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("batch") <= self.batch)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows as the next batch's part of a table, read back."""
        place = f"{self.folder}/{name}/batch={self.batch + 1}"
        rows.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(rows.schema).parquet(place)

    def files(self) -> DataFrame:
        """(path, checksum, batch) of the files that are there."""
        last = self.table("files").groupBy("path").agg(F.max_by(F.struct("checksum", "gone", "batch"), "batch").alias("f")).select("path", "f.*")
        return last.where(~F.col("gone")).drop("gone")

    def of_files(self, name: str) -> DataFrame:
        """What the files that are there say."""
        live = self.files().select(F.col("path").alias("l_path"), F.col("batch").alias("l_batch"))
        rows = self.table(name)
        return rows.join(live, (F.col("file") == F.col("l_path")) & (F.col("batch") == F.col("l_batch")), "left_semi").drop("batch")

    def _changed_in(self, name: str) -> DataFrame:
        return self.table("dirty").groupBy("id").agg(F.max("batch").alias("changed")).select(F.col("id").alias(f"{name}_node"), F.col("changed").alias(f"{name}_changed"))

    def of_nodes(self, name: str, but: DataFrame | None = None) -> DataFrame:
        """The rows of nodes as they are now, without those of some nodes (id)."""
        last = self._changed_in("own")
        if but is not None:
            last = last.join(but.select(F.col("id").alias("own_node")), "own_node", "left_anti")
        return self.table(name).join(last, (F.col("id") == F.col("own_node")) & (F.col("batch") == F.col("own_changed")), "left_semi").drop("batch")

    def scored(self) -> DataFrame:
        s, t = self._changed_in("source"), self._changed_in("target")
        rows = self.table("scored").join(s, F.col("source_id") == F.col("source_node")).join(t, F.col("target_id") == F.col("target_node"))
        return rows.where(F.greatest("source_changed", "target_changed") == F.col("batch")).select("source_id", "target_id", "relationship", "score", "tokens", "mapper")

    def graph(self) -> dict[str, DataFrame]:
        """nodes, edges, candidates, rejected, errors and claims, as ingest.build() gives them."""
        stored: linking.Mapper = lambda *_: self.scored()
        out = ingest.assemble(self.of_nodes("nodes"), self.of_files("edges"), self.of_files("words"), [stored, linking.by_names, linking.by_classes, linking.by_code])
        return out | {"errors": self.of_files("errors").select(F.col("file").alias("source_file"), "description"), "claims": self.of_files("pieces").select("file", F.col("id").alias("node_id")).distinct()}


def _but(rows: DataFrame | None, gone: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among the gone, and the fresh ones."""
    return fresh if rows is None else rows.join(gone, key, "left_anti").select(*fresh.columns).unionByName(fresh)


def update(files: DataFrame, folder: str, complete: bool = True, hooks: Hooks | None = None) -> dict[str, int]:
    """Take in files (path, checksum, content) that are new or changed; returns counters.

    `complete` says that files are all there are, so that others are deleted;
    otherwise only those with a null content are.  When nothing changed, only
    paths and checksums are read and nothing is written.
    """
    spark, hooks = files.sparkSession, hooks or Hooks()
    hooks.fire("before_ingest", files)
    state = State(spark, folder)
    known = state.files() if state.batch >= 0 else spark.createDataFrame([], "path string, checksum string, batch int")
    found = eligible(files)
    there = found.where("content is not null") if not complete else found
    changed = there.join(known.select("path", "checksum"), ["path", "checksum"], "left_anti")
    lost = known.join(there.select("path"), "path", "left_anti") if complete else known.join(found.where("content is null").select("path"), "path", "left_semi")
    moved = graph.written(changed.select("path", "checksum", F.lit(False).alias("gone")).unionByName(lost.select("path", "checksum", F.lit(True).alias("gone"))))
    n = moved.agg(F.count_if(~F.col("gone")).alias("parsed"), F.count_if("gone").alias("deleted")).head()
    counts = {"parsed_files": n.parsed, "deleted_files": n.deleted, "cached_files": known.count() - n.deleted - moved.join(known, "path", "left_semi").where("not gone").count(), "error_files": 0, "nodes_added": 0, "nodes_removed": 0, "dirty_nodes": 0, "batch": state.batch}
    if not n.parsed and not n.deleted:
        hooks.fire("after_ingest", counts)
        return counts

    return counts | take_in(state, ingest.facts(changed.select("path", "content")), moved, hooks)


def take_in(state: State, said: dict[str, DataFrame], moved: DataFrame, hooks: Hooks | None = None) -> dict[str, int]:
    """The next batch, of what files say (see ingest.facts) and of the files (path, checksum, gone) that say it or are gone; returns counters."""
    spark, hooks = state.spark, hooks or Hooks()
    hooks.fire("after_parse", said)
    hooks.fire("before_write", said)
    new = {name: state.write(name, said[name]) for name in OF_FILES}
    paths = moved.select(F.col("path").alias("file"))
    old = state.of_files("pieces") if state.batch >= 0 else None
    dirty = new["pieces"].select("id") if old is None else new["pieces"].select("id").unionByName(old.join(paths, "file", "left_semi").select("id"))
    dirty = state.write("dirty", dirty.distinct())
    pieces = _but(old, paths, new["pieces"], "file")
    before = state.of_nodes("nodes").select("id", F.lit(True).alias("was")) if state.batch >= 0 else spark.createDataFrame([], "id string, was boolean")
    seen = Observation(f"nodes-{uuid.uuid4().hex}")
    folded = ingest.nodes_of(pieces.join(dirty, "id", "left_semi"))
    folded = folded.join(before, "id", "left").observe(seen, F.count_if("was").alias("stay"), F.count(F.lit(1)).alias("all")).drop("was")
    nodes = state.write("nodes", folded)
    if state.batch < 0:
        _fit(state, nodes)
    weights = state.write("weights", _weights(state, nodes))
    with scope(spark):
        present = weights if state.batch < 0 else graph.written(weights.unionByName(state.of_nodes("weights", dirty), allowMissingColumns=True))
        state.write("scored", linking.scored(present, present, lambda a, b: similarity.incremental_pairs(a, b, linking.marked_ids(dirty), CANDIDATE)))
    state.write("files", moved)
    had = before.join(dirty, "id", "left_semi").count()
    counts = {"error_files": new["errors"].select("file").distinct().count(), "dirty_nodes": dirty.count(), "nodes_removed": had - seen.get["stay"], "nodes_added": seen.get["all"] - seen.get["stay"], "batch": state.batch + 1}
    hooks.fire("after_ingest", counts)
    return counts


def _fit(state: State, nodes: DataFrame) -> None:
    """The IDF of these nodes' terms, for this and all later batches."""
    postings = similarity.term_table(linking.node_text(nodes))
    n = nodes.count()
    similarity.idf_table(postings, n).withColumn("n_docs", F.lit(n)).write.mode("overwrite").parquet(f"{state.folder}/idf")
    state.spark.range(1).select(F.lit(n).cast("bigint").alias("n_docs")).write.mode("overwrite").parquet(f"{state.folder}/corpus")


def _weights(state: State, nodes: DataFrame) -> DataFrame:
    idf, n = state.spark.read.parquet(f"{state.folder}/idf"), state.spark.read.parquet(f"{state.folder}/corpus").head().n_docs
    return linking.with_kind(similarity.late_documents(linking.node_text(nodes), idf, n, CANDIDATE), nodes).select("id", "term", "idf", "w", "norm2", "rest", "type", "origin")


def fit_again(spark: SparkSession, folder: str) -> None:
    """The IDF of the nodes as they are; all of them are weighed and compared again, in a batch of its own."""
    state = State(spark, folder)
    nodes = graph.written(state.of_nodes("nodes"))
    _fit(state, nodes)
    state.write("dirty", nodes.select("id"))
    state.write("nodes", nodes)
    for name in OF_FILES:
        state.write(name, state.of_files(name).limit(0))
    weights = state.write("weights", _weights(state, nodes))
    state.write("scored", linking.scored(weights, weights, lambda a, b: similarity.cosine_pairs(a, b, CANDIDATE)))
    state.write("files", state.table("files").drop("batch").limit(0))


def follow(events: DataFrame, folder: str, checkpoint: str, hooks: Hooks | None = None, on_batch: Callable[[dict[str, int]], None] | None = None):
    """A stream of files (path, content; null content: deleted) whose micro-batches update the graph in order; starts and returns the query.

    Of a path that comes more than once in a micro-batch, the last by `at` counts
    if there is such a column, else the one with the greatest checksum.
    """
    keyed = events.withColumn("checksum", F.sha2(F.col("content").cast("binary"), 256))

    def batch(rows: DataFrame, _: int) -> None:
        order = F.struct("at", "checksum") if "at" in rows.columns else F.struct(F.col("checksum"))
        one = rows.groupBy("path").agg(F.max_by(F.struct("content", "checksum"), order).alias("f")).select("path", "f.content", "f.checksum")
        counts = update(graph.written(one), folder, complete=False, hooks=hooks)
        if on_batch:
            on_batch(counts)

    return keyed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
