"""From a table of files to a graph: parse, fold, link, deduplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import fold, framework, graph, linking, merge
from loomgraph.plans.schema import policy_table
from loomgraph.sources import text_parsers
from loomgraph.sources.code_parsers import parse_files, read_csv_sheets, read_sheets
from loomgraph.sources.files import eligible, extension, parser_kind, priority


#: Places of edges that are inferred, after all that files say.
LAST = 1 << 30
PLACE = "struct<priority: int, file: string, pos: bigint, tie: bigint>"


def parsed_rows(files: DataFrame) -> DataFrame:
    """Nodes, edges and errors of files (path, content) in one table, with the place of each (priority, path, position) as priority, source_file and pos."""
    routed = eligible(files).withColumn("text", F.col("content").cast("string")).withColumn("kind", parser_kind())
    rows = parse_files(routed).withColumn("pos", F.monotonically_increasing_id())
    text = routed.select("path", "text", "kind")
    nodes, edges = text_parsers.markdown(text.where("kind = 'markdown'"))
    constants = text_parsers.properties(text.where("kind = 'properties'")).select("id", "type", "name", F.col("raw_value").alias("description"), F.col("path").alias("source_file"), F.to_json(F.struct("value_type")).alias("metadata"))
    raw = F.startswith("text", F.lit("%PDF-"))
    pdf = text_parsers.document_sections(text.where((F.col("kind") == "pdf") & ~raw))
    sheets = read_sheets(routed.where("kind = 'excel'")).unionByName(read_csv_sheets(routed.where("kind = 'csv'")))
    failed = sheets.where("error is not null").select("path", F.col("error").alias("description")).unionByName(text.where((F.col("kind") == "pdf") & raw).select("path", F.lit("a PDF file whose text has not been extracted").alias("description")))
    for found in (nodes, constants, pdf, text_parsers.sheet_nodes(sheets)):
        rows = rows.unionByName(found.select(F.lit("node").alias("row"), "*"), allowMissingColumns=True)
    rows = rows.unionByName(edges.select(F.lit("edge").alias("row"), "*"), allowMissingColumns=True)
    rows = rows.unionByName(failed.select(F.lit("error").alias("row"), F.col("path").alias("source_file"), "description"), allowMissingColumns=True)
    return rows.withColumn("priority", priority("source_file"))


def _place(*tie: str):
    """Where a row stands among all: by its file's priority and path, its position in the file, and what it says."""
    return F.struct(F.col("priority").cast("int").alias("priority"), F.col("source_file").alias("file"), F.col("pos").cast("bigint").alias("pos"), F.xxhash64(*tie).alias("tie"))


def _after(level: int):
    return F.struct(F.lit(LAST + level).alias("priority"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("tie"))


def facts(files: DataFrame) -> dict[str, DataFrame]:
    """What each of the files (path, content) says, whatever other files say, with its `file`.

    pieces of nodes (see fold; one for each node and file), edges (source_id,
    target_id, relationship, ord), words (see framework) and errors (description).
    Facts of different files can be stored, replaced and put together at will.
    """
    rows = graph.written(parsed_rows(files))
    updates = merge.governed(rows.where("row = 'node' and id is not null").withColumn("metadata", F.coalesce("metadata", F.lit("{}"))))
    updates = updates.select("id", _place("name", "description").alias("ord"), "type", "name", "description", "metadata", merge.origin_of().alias("origin"), "source_file")
    pieces = fold.combine(fold.pieces_of(updates).withColumn("file", F.col("files")[0]), ("id", "file"))
    edges = rows.where("row = 'edge'").select(F.col("source_file").alias("file"), "source_id", "target_id", "relationship", _place("source_id", "target_id", "relationship").alias("ord"))
    code = eligible(files).where(extension().isin("java", "ts", "tsx", "js", "jsx", "py", "go")).select("path", F.col("content").cast("string").alias("content"))
    return {"pieces": pieces, "edges": edges, "words": framework.words_of(code), "errors": rows.where("row = 'error'").select(F.col("source_file").alias("file"), "description")}


def nodes_of(pieces: DataFrame) -> DataFrame:
    """Whole nodes of pieces, with the metadata that operators look at as columns."""
    nodes = fold.nodes_of(fold.combine(pieces))
    return nodes.select("*", *(F.get_json_object("metadata", f"$.{c}").alias(c) for c in ("rule_origin", "path", "class_name", "http_method", "language", "framework")))


def assemble(nodes: DataFrame, edges: DataFrame, words: DataFrame | None, mappers: list[linking.Mapper] | None = None) -> dict[str, DataFrame]:
    """nodes, edges, candidates and rejected edges of written nodes and of what files say of edges: ends checked, edges inferred, endpoints merged."""
    stated = edges.select("source_id", "target_id", "relationship", "ord", F.lit(1.0).alias("confidence"))
    taken, rejected = graph.split_edges(stated, nodes)
    taken = graph.written(graph.last_edges(taken))
    new, candidates = linking.infer(nodes, taken, policy_table(nodes.sparkSession), mappers, words)
    guess = ~F.col("mapper").isin(*linking.READING)
    placed = new.select("source_id", "target_id", "relationship", F.when(guess, _after(1)).otherwise(_after(0)).alias("ord"), F.bround("score", 4).alias("confidence"))
    linked = graph.last_edges(taken.select(placed.columns).unionByName(placed))
    specified = F.coalesce(F.array_contains(F.json_object_keys("metadata"), "responses"), F.lit(False))
    endpoints = nodes.where("type = 'api_endpoint'").select("id", "path", "http_method", specified.alias("has_spec"), "ord", "description")
    twins = graph.written(merge.duplicate_endpoints(endpoints))
    kept = nodes.join(twins.where("id != primary").select("id"), "id", "left_anti")
    return {"nodes": kept, "edges": graph.last_edges(merge.rewire(linked, twins)), "candidates": candidates, "rejected": rejected}


def build(files: DataFrame, mappers: list[linking.Mapper] | None = None) -> dict[str, DataFrame]:
    """nodes, edges, candidates, rejected, errors and claims of a workspace's files.

    Updates of a node and edges of a pair follow one another by the files'
    priority, then path, then position; inferred edges come last.
    """
    said = facts(files)
    pieces = graph.written(said["pieces"])
    out = assemble(graph.written(nodes_of(pieces)), said["edges"], graph.written(said["words"]), mappers)
    return out | {"errors": said["errors"].select(F.col("file").alias("source_file"), "description"), "claims": pieces.select("file", F.col("id").alias("node_id")).distinct()}
