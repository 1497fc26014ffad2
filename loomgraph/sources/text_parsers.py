"""Parsers that are DataFrame work: Markdown, properties, CSV, sections and locators.

Each takes files (path, text) and gives rows; nodes(..) and edges(..) have the
graph's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import concept_slug, header_name, markdown_row, node_id, value_type

# Headings that are no entity, and words that make a section a rule.
GENERIC_HEADINGS = ("purpose", "scope", "context", "background", "assumptions", "references", "revision history", "summary", "description", "table of contents", "introduction", "glossary", "appendix")
RULE_WORDS = ("rule", "validation", "requirement", "constraint", "premium", "formula")
FIELD_SPEC_HEADERS = ("field_id", "field_name", "type", "length", "mandatory", "validation", "error_message", "default", "description", "placeholder", "element_type", "selector")
# End of the fixed values.


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def sections(files: DataFrame, heading: Column, level: Column) -> DataFrame:
    """(path, no, level, heading, body): a text cut at its headings; what stands before the first has no heading."""
    by_line = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(files).withColumn("heading", heading).withColumn("level", level).withColumn("no", F.sum(F.col("heading").isNotNull().cast("int")).over(by_line))
    body = F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line"))))
    out = marked.groupBy("path", "no").agg(F.max("heading").alias("heading"), F.max("level").alias("level"), body.alias("b"))
    return out.select("path", "no", "level", "heading", F.trim(F.array_join(F.col("b.line"), "\n")).alias("body"))


def markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of headings (1 feature, 2 rule, 3 scenario) and PART_OF edges to the nearest open heading above."""
    shape = r"^(#{1,3})\s+(.+)$"
    line = F.trim("line")
    found = F.when(line.rlike(shape), F.trim(F.regexp_replace(F.regexp_extract(line, shape, 2), r"(?i)^(Feature|Rule|Scenario|Scenario Outline):\s*", "")))
    cut = sections(files, found, F.when(line.rlike(shape), F.length(F.regexp_extract(line, shape, 1)))).where("heading is not null")
    kind = F.when(F.col("level") == 1, "product_feature").when(F.col("level") == 2, "business_rule").otherwise("test_scenario")
    generic = F.lower("heading").isin(*GENERIC_HEADINGS)
    named = cut.withColumn("type", kind).withColumn("generic", generic).withColumn("id", F.when(~generic, node_id(kind, "heading")))
    # A generic heading closes those of its level and below: it counts as a parent without id.
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda level: F.last(F.when(F.col("level") == level, F.struct("no", "id")), ignorenulls=True).over(before)
    named = named.withColumn("h1", last(1)).withColumn("h2", last(2))
    h2 = F.when(F.col("h1").isNull() | (F.col("h2.no") > F.col("h1.no")), F.col("h2.id"))
    parent = F.when(F.col("level") == 2, F.col("h1.id")).when(F.col("level") == 3, F.coalesce(h2, F.col("h1.id")))
    named = named.withColumn("parent", parent).where("not generic")
    nodes = named.select("id", "type", F.col("heading").alias("name"), F.col("body").alias("description"), F.col("path").alias("source_file"), F.col("no").cast("bigint").alias("pos"))
    edges = named.where("parent is not null").select(F.col("id").alias("source_id"), F.col("parent").alias("target_id"), F.lit("PART_OF").alias("relationship"), F.col("path").alias("source_file"), F.col("no").cast("bigint").alias("pos"))
    return nodes, edges


def properties(files: DataFrame) -> DataFrame:
    """A rule_constant for each key: id, name, value_type, raw_value, path; a repeated key gives its last value."""
    shape = r"^\s*([^#!\s=:][^=:]*?)\s*[=:]\s*(.*)$"
    rows = lines(files).where(F.col("line").rlike(shape)).select("path", "pos", F.trim(F.regexp_extract("line", shape, 1)).alias("name"), F.trim(F.regexp_extract("line", shape, 2)).alias("raw_value"))
    one = rows.groupBy("path", "name").agg(F.max_by("raw_value", "pos").alias("raw_value"), F.count("*").alias("times"))
    return one.select(F.concat(F.lit("rule_constant_"), concept_slug("name")).alias("id"), F.lit("rule_constant").alias("type"), "name", "raw_value", value_type("raw_value").alias("value_type"), "times", "path")


def sheet_kind(headers: Column) -> Column:
    """dataresource, field_spec or narrative_or_data, from an array of headers."""
    norm = F.transform(F.filter(headers, lambda h: F.coalesce(h, F.lit("")) != ""), header_name)
    spec = F.size(F.array_intersect(F.array_distinct(norm), F.array(*map(F.lit, FIELD_SPEC_HEADERS)))) >= 3
    return F.when(F.array_contains(norm, "reference"), "dataresource").when(spec, "field_spec").otherwise("narrative_or_data")


def sheet_nodes(sheets: DataFrame) -> DataFrame:
    """Nodes of sheets (path, sheet, headers array, rows array of arrays): one for each row of a field specification, else one for the sheet."""
    norm = F.transform("headers", header_name)
    typed = sheets.where("headers is not null").withColumn("kind", sheet_kind(F.col("headers"))).withColumn("norm", norm)
    key = F.coalesce(*(F.nullif(F.array_position("norm", c), F.lit(0)) for c in ("field_id", "id", "element_id", "key")))
    rows = typed.where("kind = 'field_spec'").withColumn("key", key).where("key is not null").select("path", "sheet", "norm", "key", F.explode("rows").alias("row"))
    cell = lambda name: F.get("row", (F.array_position("norm", name) - 1).cast("int"))
    value = F.trim(F.get("row", (F.col("key") - 1).cast("int")))
    spec = rows.withColumn("fid", value).where("fid != ''").select(F.concat(F.lit("field_spec_"), concept_slug("fid")).alias("id"), F.lit("field_specification").alias("type"), F.concat(F.lit("Field Spec: "), F.coalesce(cell("field_name"), F.col("fid"))).alias("name"), F.to_json(F.map_from_arrays("norm", "row")).alias("description"), F.col("path").alias("source_file"))
    grid = F.array_join(F.concat(F.array(markdown_row(F.col("headers")), markdown_row(F.transform("headers", lambda _: F.lit("---")))), F.transform("rows", markdown_row)), "\n")
    whole = typed.where("kind != 'field_spec'").select(F.concat(F.lit("rule_"), concept_slug("sheet")).alias("id"), F.lit("business_rule").alias("type"), F.col("sheet").alias("name"), grid.alias("description"), F.col("path").alias("source_file"))
    return spec.unionByName(whole)


def document_sections(files: DataFrame, levels: bool = True) -> DataFrame:
    """Nodes of numbered or styled headings in document text (path, text): rules where a rule word is in the heading, else features."""
    shape = r"^(\d+(?:\.\d+)*)[.)]?\s+([A-Z][^\n]{2,80})$"
    cut = sections(files, F.when(F.col("line").rlike(shape), F.regexp_extract("line", shape, 2)), F.when(F.col("line").rlike(shape), F.size(F.split(F.regexp_extract("line", shape, 1), r"\."))))
    rule = F.lit(False)
    for word in RULE_WORDS:
        rule = rule | F.contains(F.lower("heading"), F.lit(word))
    kind = F.when(rule, "business_rule").otherwise("product_feature")
    body = F.when(F.length("body") > 1000, F.concat(F.substring("body", 1, 1000), F.lit("..."))).otherwise(F.col("body"))
    kept = cut.where(F.col("heading").isNotNull() & (F.length("body") >= 30))
    return kept.select(node_id(kind, "heading").alias("id"), kind.alias("type"), F.col("heading").alias("name"), body.alias("description"), F.col("path").alias("source_file"))


def locators(files: DataFrame) -> DataFrame:
    """(path, key, selector, times): locator entries of property-like files; the last of a key counts."""
    shape = r"^\s*([\w.]+)\s*=\s*(.+)$"
    rows = lines(files).where(F.col("line").rlike(shape) & ~F.trim("line").startswith("#")).select("path", "pos", F.regexp_extract("line", shape, 1).alias("key"), F.trim(F.regexp_extract("line", shape, 2)).alias("selector"))
    return rows.groupBy("path", "key").agg(F.max_by("selector", "pos").alias("selector"), F.count("*").alias("times"))


def bind_locators(used: DataFrame, known: DataFrame, default: str = "unresolved") -> DataFrame:
    """Used keys (page_id, key) with their literal selectors."""
    table = known.groupBy("key").agg(F.min("selector").alias("selector"))
    return used.join(table, "key", "left").withColumn("selector", F.coalesce("selector", F.lit(default)))
