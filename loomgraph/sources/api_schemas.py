"""API descriptions in JSON as tables: models with all their properties, endpoints, and which models these use.

Schemas refer to one another and are put together of parts (allOf, oneOf,
anyOf).  Each is read once, with its parts level by level: its properties and
references are rows then.  References are followed level by level on these rows
until none is left.  A branch does not follow a reference twice, which ends
cycles.  Where a property comes more than once, the later place decides: a schema's
own properties come after its parts, these in the order of allOf, oneOf and anyOf,
and what it refers to comes first.

Cases: texts that are no JSON object have no models and endpoints; references
that lead nowhere and schemas that are no objects have no properties; a property
that is no object is `any`, one without a type is named by its reference, or
`object`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import node_id
from loomgraph.operators.graph import written

# Methods of endpoints, and how schemas are put together, in their order.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
PARTS = ("allOf", "oneOf", "anyOf")
# End of the fixed values.
OWN = len(PARTS) + 1
# Schemas of one task, in so many tasks as there are cores at least.
SHARE = 20_000


def _field(json: str | Column, name: str) -> Column:
    return F.get_json_object(json, f"$['{name}']")


def _members(json: Column) -> Column:
    """(key, value as JSON) of an object."""
    return F.transform(F.map_entries(F.from_json(json, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))


def _last_segment(reference: Column) -> Column:
    return F.element_at(F.split(reference, "/"), -1)


def models(files: DataFrame) -> DataFrame:
    """(path, name, title, schema) of the models of files (path, text)."""
    listed = F.coalesce(_field(_field("text", "components"), "schemas"), _field("text", "definitions"))
    rows = files.select("path", F.explode(_members(listed)).alias("m")).select("path", F.col("m.key").alias("name"), F.col("m.value").alias("schema"))
    return rows.select("path", "name", F.coalesce(_field("schema", "title"), "name").alias("title"), "schema")


def _parts(step: int, name: str) -> Column:
    """(steps, schema) of the parts that a schema is put together of in one way."""
    listed = F.coalesce(F.from_json(_field("schema", name), "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(listed, lambda part, pos: F.struct(F.array(F.lit(step), pos).alias("steps"), F.to_json(part).alias("schema")))


def _read(schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, name, place, property, type) and (path, name, place, ref) that each schema holds itself or in its parts."""
    inside = schemas.withColumn("place", F.array().cast("array<int>"))
    own, references = [], []
    while True:
        inside = written(inside.where(F.startswith("schema", F.lit("{"))))
        if own and inside.isEmpty():
            break
        at = lambda *steps: F.concat("place", F.array(*(F.lit(s) if isinstance(s, int) else s for s in steps)))
        held = inside.select("path", "name", at(OWN).alias("place"), F.explode(_members(_field("schema", "properties"))).alias("p"))
        inner = F.col("p.value")
        kind = F.when(~F.startswith(inner, F.lit("{")), "any").otherwise(F.coalesce(F.nullif(_field(inner, "type"), F.lit("")), _last_segment(_field(inner, "$ref")), F.lit("object")))
        own.append(held.select("path", "name", "place", F.col("p.key").alias("property"), kind.alias("type")))
        references.append(inside.select("path", "name", at(0).alias("place"), _field("schema", "$ref").alias("ref")).where(F.col("ref").isNotNull()))
        some = F.concat(*(_parts(step, part) for step, part in enumerate(PARTS, 1)))
        inside = inside.select("path", "name", "place", F.explode(some).alias("part")).select("path", "name", F.col("part.schema").alias("schema"), F.concat("place", "part.steps").alias("place"))
    return reduce(DataFrame.unionByName, own), reduce(DataFrame.unionByName, references)


def flat_properties(schemas: DataFrame) -> DataFrame:
    """(path, name, property, type) of schemas (path, name, schema as JSON), through references and parts."""
    schemas = schemas.select("path", "name", "schema")
    # A level has a few rows for each schema, which are few bytes: they would all go to one task otherwise.
    schemas = schemas.repartition(max(schemas.sparkSession.sparkContext.defaultParallelism, schemas.count() // SHARE), "path", "name")
    own, references = _read(schemas)
    roots = written(schemas.select("path", "name").distinct())
    known = roots.select(F.col("path").alias("k_path"), F.col("name").alias("target"))
    edges = references.join(known, (F.col("path") == F.col("k_path")) & (_last_segment(F.col("ref")) == F.col("target")))
    edges = written(edges.select(F.col("path").alias("e_path"), F.col("name").alias("e_name"), F.col("place").alias("step"), "ref", "target"))
    # Whose properties a model has, and at which place.
    frontier = roots.select("path", "name", F.col("name").alias("at"), F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("seen"))
    levels: list[DataFrame] = []
    while True:
        frontier = written(frontier)
        if levels and frontier.isEmpty():
            break
        levels.append(frontier.select("path", "name", "at", "place"))
        led = frontier.join(edges, F.col("path").eqNullSafe(F.col("e_path")) & F.col("at").eqNullSafe(F.col("e_name"))).where(~F.array_contains("seen", F.col("ref")))
        frontier = led.select("path", "name", F.col("target").alias("at"), F.concat("place", "step").alias("place"), F.array_append("seen", F.col("ref")).alias("seen"))
    held = written(own.groupBy(F.col("path").alias("h_path"), F.col("name").alias("h_name")).agg(F.collect_list(F.struct(F.col("place").alias("inner"), "property", "type")).alias("held")))
    found = reduce(DataFrame.unionByName, levels).join(held, F.col("path").eqNullSafe(F.col("h_path")) & F.col("at").eqNullSafe(F.col("h_name")))
    found = found.select("path", "name", "place", F.explode("held").alias("p"))
    return found.groupBy("path", "name", "p.property").agg(F.max_by("p.type", F.concat("place", "p.inner")).alias("type"))


def endpoints(files: DataFrame) -> DataFrame:
    """(path, route, http_method, description, models) of the endpoints of files (path, text); models are those that they refer to, in order."""
    routes = files.select("path", F.explode(_members(_field("text", "paths"))).alias("r")).select("path", F.col("r.key").alias("route"), F.explode(_members(F.col("r.value"))).alias("o"))
    kept = routes.where(F.lower("o.key").isin(*METHODS) & F.startswith("o.value", F.lit("{")))
    used = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("o.value", F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), 1), _last_segment)))
    return kept.select("path", "route", F.upper("o.key").alias("http_method"), F.coalesce(F.nullif(_field("o.value", "summary"), F.lit("")), _field("o.value", "description"), F.lit("")).alias("description"), used.alias("models"))


def nodes_and_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, description, metadata, source_file) and USES_MODEL edges (source_id, target_id, relationship, source_file) of files (path, text)."""
    found, served = models(files), endpoints(files)
    listed = flat_properties(found.select("path", "name", "schema")).groupBy(F.col("path").alias("p_path"), F.col("name").alias("p_name")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "type")))).alias("properties"))
    held = found.join(listed, (F.col("path") == F.col("p_path")) & (F.col("name") == F.col("p_name")), "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))
    shape = lambda kind, name, text, *meta: (node_id(F.lit(kind), name).alias("id"), F.lit(kind).alias("type"), name.alias("name"), text.alias("description"), F.to_json(F.struct(*meta)).alias("metadata"), F.col("path").alias("source_file"))
    called = F.concat_ws(" ", "http_method", "route")
    nodes = held.select(*shape("data_model", F.col("name"), F.col("title"), "properties")).unionByName(served.select(*shape("api_endpoint", called, F.col("description"), "http_method", F.col("route").alias("path"))))
    edges = served.select(node_id(F.lit("api_endpoint"), called).alias("source_id"), F.explode("models").alias("m"), F.col("path").alias("source_file"))
    return nodes, edges.select("source_id", node_id(F.lit("data_model"), F.col("m")).alias("target_id"), F.lit("USES_MODEL").alias("relationship"), "source_file")
