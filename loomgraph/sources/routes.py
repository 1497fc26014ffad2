"""Routes of controllers in source code, of any number of classes in a file.

A file becomes its marks in order: declarations of classes, annotations that map
routes, and whatever else decides what stands before what.  Windows over the marks
of a file pair them: an annotation directly before a class is the class's base, any
other belongs to the class that was declared last before it.  The marks of one
file are all that a window holds.

Cases: comments are left out; null contents have no marks; an annotation before
the first class has no class; a class without routes gives none; routes join with
single slashes and without one at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_comments

#: For each language: marks that are told apart, as (kind, pattern); the first group is a method or name, the second what stands in brackets.
MARKS = {
    "java": (("class", r"\b(?:class|interface)\s+(\w+)()"), ("route", r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(([^)]*)\))?"), ("body", r"([{};])()")),
    "typescript": (("class", r"\bclass\s+(\w+)()"), ("route", r"@(Get|Post|Put|Delete|Patch|Controller)\(([^)]*)\)"), ("body", r"([{};])()")),
}
BASES = ("Request", "Controller")
_QUOTED = r"[\"'`]([^\"'`]*)[\"'`]"


def _extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def marks(files: DataFrame, language: str) -> DataFrame:
    """(path, n, kind, name, inside): the marks of files (path, content) in order; of brackets and full stops directly after one another only the first."""
    kinds = MARKS[language]
    whole = "|".join(f"(?:{pattern})" for _, pattern in kinds)
    every = files.select("path", F.regexp_extract_all(strip_comments(F.coalesce("content", F.lit(""))), F.lit(whole), 0).alias("marks"))
    # No other mark is a single character.
    first = lambda mark, i: (F.length(mark) > 1) | (i == 0) | (F.length(F.get("marks", i - 1)) > 1)
    found = every.select("path", F.posexplode(F.filter("marks", first)).alias("n", "mark"))
    kind = name = inside = F.lit(None).cast("string")
    for k, pattern in reversed(kinds):
        hit = F.length("mark") == 1 if k == "body" else F.col("mark").rlike(f"^(?:{pattern})$")
        kind = F.when(hit, F.lit(k)).otherwise(kind)
    found = found.withColumn("kind", kind)
    for k, pattern in kinds:
        hit = F.col("kind") == k
        name = F.when(hit, F.regexp_extract("mark", pattern, 1)).otherwise(name)
        inside = F.when(hit, F.regexp_extract("mark", pattern, 2)).otherwise(inside)
    return found.select("path", "n", "kind", name.alias("name"), inside.alias("inside"))


def routes(files: DataFrame, language: str) -> DataFrame:
    """(path, class_name, http_method, route) of the mapped methods of files (path, content) in "java" or "typescript"."""
    in_file = Window.partitionBy("path").orderBy("n")
    rows = marks(files, language).withColumn("quoted", F.regexp_extract("inside", _QUOTED, 1))
    # A span is routes and the mark after them that is none; a base stands in the span of its class.  Every window goes
    # over its rows once: a frame up to the end of the file would be read anew for each of them.
    span = F.sum(F.when(F.col("kind") != "route", 1).otherwise(0)).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("span", F.coalesce(span, F.lit(0)))
    in_span = Window.partitionBy("path", "span")
    base = (F.col("kind") == "route") & F.col("name").isin(*BASES)
    rows = rows.withColumn("next", F.max(F.when(F.col("kind") != "route", F.col("kind"))).over(in_span))
    rows = rows.withColumn("own_base", F.max(F.when(base, F.struct("n", "quoted"))).over(in_span)["quoted"])
    rows = rows.withColumn("is_base", base & (F.col("next") == "class"))
    # Only routes and classes go on; the last class before a route is its own.
    rows = rows.where("kind != 'body'").withColumn("base", F.when(F.col("kind") == "class", F.coalesce("own_base", F.lit(""))))
    before = in_file.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.last(F.when(F.col("kind") == "class", F.struct("name", "base")), ignorenulls=True).over(before))
    kept = rows.where((F.col("kind") == "route") & ~F.col("is_base") & ~((F.col("name") == "Controller")) & (F.col("next").isNull() | (F.col("next") != "class")))
    method = F.when(F.col("name") == "Request", F.coalesce(F.nullif(F.regexp_extract("inside", r"RequestMethod\.(\w+)", 1), F.lit("")), F.lit("GET"))).otherwise(F.upper("name"))
    whole = F.regexp_replace(F.concat_ws("/", F.lit(""), F.coalesce("c.base", F.lit("")), "quoted"), "/{2,}", "/")
    return kept.select("path", F.col("c.name").alias("class_name"), method.alias("http_method"), F.coalesce(F.nullif(F.regexp_replace(whole, "/$", ""), F.lit("")), F.lit("/")).alias("route"))


def endpoints(files: DataFrame) -> DataFrame:
    """routes() of all files (path, content) whose extension says a language."""
    java = routes(files.where(_extension("path") == "java"), "java")
    return java.unionByName(routes(files.where(_extension("path").isin("ts", "tsx", "js", "jsx")), "typescript"))
