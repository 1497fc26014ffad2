"""Workspaces as tables of files, and the kind of parser that each file needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import checksum

# What a walk leaves out and takes.
PRUNED = (".git", "node_modules", "target", "build", "dist", ".gradle", ".idea", ".vscode")
EXTENSIONS = ("docx", "pdf", "xlsx", "csv", "feature", "json", "yaml", "yml", "md", "bdd", "loc", "properties", "java", "ts", "tsx", "js", "jsx", "py", "go")
MANIFESTS = {"package.json": ("playwright", "cypress", "jest", "express", "react"), "pom.xml": ("spring", "qaf", "junit", "selenium"), "build.gradle": ("spring", "junit"), "requirements.txt": ("fastapi", "flask", "pytest"), "go.mod": ("gin",)}
# The cases of names that the vote on naming tells apart; the votes depend on them.
NAMING = (("snake_case", r"^[a-z]+(_[a-z0-9]+)+\b"), ("camelCase", r"^[a-z]+([A-Z][a-zA-Z0-9]+)+\b"), ("PascalCase", r"^[A-Z][a-zA-Z0-9]+\b"))
NAME = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
# End of the fixed values.

#: Up to so many triggers are broadcast (some 200 bytes each).
MAX_TRIGGERS = 10_000


def extension(path: str | Column = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def base_name(path: str | Column = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]*$", 0))


def read_workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content, checksum): the eligible files below root, contents as text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/")
    path = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    rel = F.expr(f"substring(regexp_replace(path, '^\\\\w+:/*', '/'), {len(prefix) + 2})") if "://" not in prefix else F.substring(path, len(prefix) + 2, 1 << 20)
    return eligible(raw.select(rel.alias("path"), F.col("length").alias("size"), "content", checksum("content").alias("checksum")))


def eligible(files: DataFrame, extra_pruned: tuple[str, ...] = ()) -> DataFrame:
    """Files outside pruned folders with a known extension, with their priority (0 is parsed first)."""
    pruned = F.array(*map(F.lit, (*PRUNED, *extra_pruned)))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    return files.where(~F.arrays_overlap(folders, pruned) & extension().isin(*EXTENSIONS)).withColumn("priority", priority())


def priority(path: str = "path") -> Column:
    name, ext = base_name(path), extension(path)
    return (
        F.when(ext.isin("properties", "loc") | F.contains(name, F.lit("locator")) | F.contains(name, F.lit("selector")), 0)
        .when(ext.isin("bdd", "feature", "md"), 1).when(F.contains(name, F.lit("page")) | F.contains(name, F.lit("pom")), 2).otherwise(3)
    )


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy("priority", "path")


def parser_kind(path: str = "path", text: str | Column = "text") -> Column:
    """Which parser a file goes to, by extension, path and what it holds."""
    ext, name = extension(path), base_name(path)
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    locators = F.contains(name, F.lit("locator")) | F.contains(name, F.lit("selector")) | t.rlike(r"(?m)^[\w.]+\s*=\s*(xpath|css|id|name)\s*=")
    framework = t.rlike(r"createBdd|@playwright/test|page\.locator\(") & ext.isin("ts", "js", "tsx", "jsx")
    qaf = t.rlike(r"com\.qmetry\.qaf|@QAFTestStep|WebDriverBaseTestPage") & (ext == "java")
    kind = F.when(ext == "docx", "word").when(ext == "pdf", "pdf").when(ext == "xlsx", "excel").when(ext == "csv", "csv").when(ext == "feature", "gherkin").when(ext.isin("json", "yaml", "yml"), "schema").when(ext == "md", "markdown")
    kind = kind.when(ext.isin("bdd", "loc") | ((ext == "properties") & locators) | qaf, "qaf").when(ext == "properties", "properties").when(framework, "playwright")
    return kind.when(ext == "java", "java").when(ext.isin("ts", "tsx", "js", "jsx"), "typescript").when(ext == "py", "python").when(ext == "go", "go")


def frameworks(files: DataFrame) -> DataFrame:
    """(framework): named in a manifest of (path, text)."""
    hits = None
    for manifest, names in MANIFESTS.items():
        for name in names:
            hit = F.when((base_name() == manifest) & F.contains(F.lower("text"), F.lit(name)), name)
            hits = [hit] if hits is None else [*hits, hit]
    return files.select(F.explode(F.array_compact(F.array(*hits))).alias("framework")).distinct()


def standards(files: DataFrame, max_files: int | None = 15) -> DataFrame:
    """One row: the dominant indentation and naming of code files (path, text).

    `max_files` is the feature's sample: the first files by path; None takes all.
    """
    code = files.where(extension().isin("java", "ts", "js", "py", "go"))
    if max_files:
        code = code.orderBy("path").limit(max_files)
    lines = code.select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) != ''")
    lead = F.regexp_extract("line", r"^\s*", 0)
    width = F.length(lead)
    indent = F.when(F.contains(lead, F.lit("\t")), "tabs").when(width == 0, None).when(width % 4 == 0, "4_spaces").when(width % 2 == 0, "2_spaces")
    token = F.explode(F.regexp_extract_all("line", F.lit(NAME), 0)).alias("t")
    # A word of three letters with a capital is no vote.
    naming = F.coalesce(*(F.when(F.col("t").rlike(shape) & (F.lit(case != "PascalCase") | (F.length("t") > 3)), case) for case, shape in NAMING))
    votes = lines.select(F.lit("indentation").alias("what"), indent.alias("vote")).unionAll(lines.select(token).select(F.lit("naming_convention"), naming)).where("vote is not null")
    counts = votes.groupBy("what", "vote").agg(F.count("*").alias("n"))
    best = counts.groupBy("what").agg(F.max_by("vote", F.struct("n", "vote")).alias("vote"))
    pick = lambda what, default: F.coalesce(F.max(F.when(F.col("what") == what, F.col("vote"))), F.lit(default)).alias(what)
    return best.agg(pick("indentation", "2_spaces"), pick("naming_convention", "camelCase"))


def standards_for(paths: DataFrame, patterns: list[tuple[str, str]], default: str) -> DataFrame:
    """(path, standard): of the first glob, or substring, that a path matches; * also crosses slashes."""
    found = F.lit(default)
    for glob, name in reversed(patterns):
        regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in glob) + "$"
        found = F.when(F.col("path").rlike(regex) | F.contains("path", F.lit(glob)), name).otherwise(found)
    return paths.withColumn("standard", found)


def dominant_folder(files: DataFrame, kind: str) -> DataFrame:
    """The folder that most files with this in their name are in; the first by name on ties."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    counts = files.where(F.contains(base_name(), F.lit(kind))).groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "folder").limit(1)


def agents_for(files: DataFrame, triggers: DataFrame) -> DataFrame:
    """(agent): those whose trigger (agent, ext, pattern or null) fits a file (path, text); few triggers are broadcast."""
    t = F.broadcast(triggers) if triggers.limit(MAX_TRIGGERS + 1).count() <= MAX_TRIGGERS else triggers
    hit = files.withColumn("e", extension()).join(t, F.col("e") == F.col("ext"))
    return hit.where(F.col("pattern").isNull() | F.expr("text rlike pattern")).select("agent").distinct()
