"""Standards, scaffolding and reusable methods that a workspace shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Priority lists and names that are no helper.
SEMANTIC_FIRST = ("getByRole", "getByLabel", "getByPlaceholder", "getByText", "getByTestId", "css", "xpath")
PLAIN_FIRST = ("id", "name", "css", "xpath", "link")
NO_HELPER = ("main", "toString", "hashCode", "equals", "constructor", "if", "for", "while", "switch", "__init__")
# End of the fixed values.

#: For each family of languages the pattern of a method: name, parameters.
METHODS = {
    # Modifiers in any order with public among them, type parameters, a return type that may have blanks in its generics and array marks, what it throws, and a body.
    "java": r"(?<![\w.])(?=(?:[a-z]+\s+)*public\s)(?:(?:public|static|final|synchronized|abstract|default|native|strictfp)\s+)+(?:<[^(){};]*>\s*)?[A-Za-z_][\w.]*(?:\s*<[^(){};=]*>)?(?:\s*\[\s*\])*\s+([A-Za-z_]\w*)\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:throws\s+[\w.,\s]+)?[{;]",
    "typescript": r"(?m)^\s*(?:public\s+|static\s+|export\s+|async\s+|function\s+)+(\w+)\s*\(([^)]*)\)",
    "python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    "go": r"(?m)^func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)\s*\(([^)]*)\)",
}


def locator_priority(pages: DataFrame) -> DataFrame:
    """One row: the order in which to try locators, from pages' selectors (selector)."""
    semantic = F.count_if(F.contains("selector", F.lit("getBy"))) > 0
    return pages.agg(F.when(semantic, F.array(*map(F.lit, SEMANTIC_FIRST))).otherwise(F.array(*map(F.lit, PLAIN_FIRST))).alias("priority"))


def template_of(content: str | Column, class_name: str | Column) -> Column:
    """A sample with its class's name made a placeholder."""
    return F.replace(F.col(content) if isinstance(content, str) else content, F.col(class_name) if isinstance(class_name, str) else class_name, F.lit("${className}"))


def methods(utilities: DataFrame) -> DataFrame:
    """(utility_id, name, parameters): the public methods in (utility_id, language, content)."""
    found = F.array().cast("array<struct<name:string,parameters:string>>")
    for language, pattern in METHODS.items():
        names, parameters = F.regexp_extract_all("content", F.lit(pattern), 1), F.regexp_extract_all("content", F.lit(pattern), 2)
        pairs = F.transform(F.arrays_zip(names.alias("name"), parameters.alias("parameters")), lambda x: F.struct(x["name"].alias("name"), x["parameters"].alias("parameters")))
        found = F.when(F.col("language") == language, pairs).otherwise(found)
    rows = utilities.select("utility_id", F.explode(found).alias("m")).select("utility_id", "m.name", F.trim("m.parameters").alias("parameters"))
    return rows.where(~F.col("name").isin(*NO_HELPER)).distinct()


def register(registered: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Capabilities (utility_id, source_file, methods) with fresh ones in place of old, and those of missing files gone."""
    kept = registered.join(fresh.select("utility_id"), "utility_id", "left_anti").unionByName(fresh)
    return kept.join(files.select(F.col("path").alias("source_file")), "source_file", "left_semi").select(*registered.columns)


def reusable_methods(capabilities: DataFrame) -> DataFrame:
    """(utility_id, method): the flat list over (utility_id, methods)."""
    return capabilities.select("utility_id", F.explode("methods").alias("method"))


def filled_policy(given: DataFrame, defaults: DataFrame, key: str = "relationship") -> DataFrame:
    """The given rows, and the default ones whose key is not given."""
    return given.unionByName(defaults.join(given.select(key).distinct(), key, "left_anti").select(*given.columns))
