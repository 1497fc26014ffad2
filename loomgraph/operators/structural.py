"""Edges inferred from the structure of test code and services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The languages that may refer to one another.
SAME_FAMILY = {"typescript": "js", "javascript": "js", "java": "java", "python": "python", "go": "go"}


def family(language: str):
    names = F.create_map(*(F.lit(x) for p in SAME_FAMILY.items() for x in p))
    return F.coalesce(F.element_at(names, F.lower(language)), F.lower(language))


def imported_names(files: DataFrame) -> DataFrame:
    """(id, language, name): the last segment of every import in (id, language, content)."""
    java = F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+[\w.]+\.(\w+)\s*;"), 1)
    script = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"import\s*\{([^}]*)\}\s*from"), 1), lambda s: F.transform(F.split(s, ","), lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+\w+", "")))))
    default = F.regexp_extract_all("content", F.lit(r"import\s+(\w+)\s+from"), 1)
    names = F.when(family("language") == "java", java).otherwise(F.concat(script, default))
    return files.select("id", "language", F.explode(F.array_distinct(F.filter(names, lambda n: n != ""))).alias("name"))


def import_edges(files: DataFrame, components: DataFrame) -> DataFrame:
    """Files to the components (id, name, type, language) that they import: CALLS to utilities, else REFERENCES."""
    names = imported_names(files).select(F.col("id").alias("source_id"), F.lower("name").alias("n"), family("language").alias("f"))
    parts = components.select(F.col("id").alias("target_id"), F.lower("name").alias("n"), family("language").alias("f"), "type")
    found = names.join(parts, ["n", "f"]).where("source_id != target_id")
    return found.select("source_id", "target_id", F.when(F.col("type") == "test_utility", "CALLS").otherwise("REFERENCES").alias("relationship")).distinct()


def mention_edges(files: DataFrame, named: DataFrame, relationship: str) -> DataFrame:
    """Files (id, content) to the nodes (id, name) whose name they hold as a word; an equi-join on the words of a file."""
    words = files.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), 0))).alias("w"))
    found = words.join(named.select(F.col("id").alias("target_id"), F.col("name").alias("w")), "w").where("source_id != target_id")
    return found.select("source_id", "target_id", F.lit(relationship).alias("relationship")).distinct()


def _classes_in_names(classes: DataFrame, components: DataFrame) -> DataFrame:
    """(held, target_id): the classes (held), in lower case and once each, that the names of components (id, name) contain, once each.

    A class name of three characters or more meets the names that hold its first
    three; shorter ones meet the names' pieces of their length.  Both are exact
    keys for containment, as many as a name is long, and are checked afterwards.
    """
    name = F.lower("name")
    n = F.length(name)
    of_length = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(*map(of_length, (1, 2, 3)))
    keys = components.where("name != ''").select(F.col("id").alias("target_id"), name.alias("whole"), F.explode(F.array_distinct(pieces)).alias("c"))
    keyed = classes.withColumn("c", F.substring("held", 1, 3))
    return keyed.join(keys, "c").where(F.contains("whole", F.col("held"))).select("held", "target_id").distinct()


def _classes(endpoints: DataFrame) -> DataFrame:
    return endpoints.where("class_name != ''").select(F.col("id").alias("source_id"), F.lower("class_name").alias("held"))


def class_endpoint_edges(endpoints: DataFrame, components: DataFrame) -> DataFrame:
    """Endpoints (id, class_name) to components (id, name) whose name contains the class, by IMPLEMENTS; classes are looked for once each."""
    classes = _classes(endpoints)
    found = classes.join(_classes_in_names(classes.select("held").distinct(), components), "held")
    return found.select("source_id", "target_id", F.lit("IMPLEMENTS").alias("relationship"), F.lit(1.0).alias("confidence")).distinct()


def class_endpoint_counts(endpoints: DataFrame, components: DataFrame) -> DataFrame:
    """(source_id, n): how many edges class_endpoint_edges() has for each endpoint that has any.

    Endpoints with the same classes have the same targets, which are counted once
    for each such set of classes: endpoints and components are not paired.
    """
    own = _classes(endpoints).groupBy("source_id").agg(F.array_sort(F.collect_set("held")).alias("classes"))
    sets = own.select("classes").distinct().select("classes", F.explode("classes").alias("held"))
    found = sets.join(_classes_in_names(sets.select("held").distinct(), components), "held")
    # What one class finds is there once already; targets of several classes may be the same.
    alone = F.size("classes") == 1
    one = found.where(alone).groupBy("classes").agg(F.count("*").alias("n"))
    more = found.where(~alone).select("classes", "target_id").distinct().groupBy("classes").agg(F.count("*").alias("n"))
    return own.join(one.unionByName(more), "classes").select("source_id", "n")


def trace_tests(calls: DataFrame, components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Steps that call a component to the endpoints of the component's file, by TESTS."""
    c = components.select(F.col("id").alias("target_id"), "source_file")
    e = endpoints.select(F.col("id").alias("endpoint_id"), "source_file")
    return calls.where("relationship = 'CALLS'").join(c, "target_id").join(e, "source_file").select("source_id", F.col("endpoint_id").alias("target_id"), F.lit("TESTS").alias("relationship")).distinct()


def model_usage(files: DataFrame, models: DataFrame) -> DataFrame:
    """Files (id, language, content) to the models (id, name, language) that they name; of another language only where theirs has none of that name."""
    words = files.select(F.col("id").alias("source_id"), family("language").alias("f"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), 0))).alias("name"))
    m = models.select(F.col("id").alias("target_id"), "name", family("language").alias("mf"))
    hits = words.join(m, "name")
    own = m.select(F.col("name").alias("n"), F.col("mf").alias("g")).distinct()
    abroad = hits.where("f != mf").join(own, (F.col("name") == F.col("n")) & (F.col("f") == F.col("g")), "left_anti")
    return hits.where("f = mf").unionByName(abroad).select("source_id", "target_id", F.lit("USES").alias("relationship")).distinct()
