"""Edges of test code: imports, page classes that steps mention, tests traced through calls, models in use, pages and rules.

Nothing here reads contents: words_of() takes from each file, once, the words
that the edges depend on, and what stands around them.  Class names are looked
for as parts of words: a name that is itself a word stands in a text where and
only where it stands in one of its words.  Names meet the different words of all
files, not the files, by the name's rarest piece of three letters, and whole
names are then compared; words and files meet afterwards by equality.

Cases: names with other characters than letters, digits and the underscore (ASCII)
are never found; null contents and names have no words; equal rows give one edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shared import materialise
from loomgraph.operators.similarity import overlapping
from loomgraph.sources.files import extension

# Names of page classes that say nothing, and frameworks by language.
PLAIN_PAGES = ("page", "basepage", "webdriverbasetestpage")
FRAMEWORKS = {"qaf_selenium": "java", "selenium": "java", "playwright": "typescript"}
# End of the fixed values.
#: Words whose names are broadcast.
COMMON = 20_000
TYPESCRIPT = ("ts", "js", "tsx", "jsx")
#: What a word stands in: (kind, pattern, group).
SIGNS = (
    ("word", r"\w+", 0), ("builder", r"(?<!\w)(\w++)\.builder\(\)", 1), ("made", r"(?<=new )\w+(?=\()", 0), ("generic", r"(?<=<)\w+(?=>)", 0), ("typed", r"(?<=:|: )\w+", 0), ("cast", r"(?<=as )\w+", 0),
)


def _language(file: str) -> Column:
    ext = extension(file)
    return F.when(ext == "java", "java").when(ext.isin(*TYPESCRIPT), "typescript")


def words_of(files: DataFrame) -> DataFrame:
    """(file, language, kind, word), once each, of files (path, content as text): imports' last segments, and words by what they stand in."""
    text = F.coalesce("content", F.lit(""))
    last = lambda x: F.element_at(F.split(F.element_at(F.split(x, r"\."), -1), "/"), -1)
    java, script = F.regexp_extract_all(text, F.lit(r"import\s+([a-zA-Z0-9_.]+);"), 1), F.regexp_extract_all(text, F.lit(r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"), 1)
    language = _language("path")
    imported = F.transform(F.when(language == "java", java).when(language == "typescript", script).otherwise(F.array().cast("array<string>")), lambda x: F.lower(last(x)))
    # Words are made distinct kind by kind, as strings, which are hashed; an array of structs would be compared pair by pair.
    sign = lambda kind: lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word"))
    found = [F.transform(F.array_distinct(words), sign(kind)) for kind, words in (("import", imported), *((kind, F.regexp_extract_all(text, F.lit(p), g)) for kind, p, g in SIGNS))]
    return files.select(F.col("path").alias("file"), language.alias("language"), F.explode(F.concat(*found)).alias("w")).select("file", "language", "w.kind", "w.word")


def _pieces(text: Column, size: int) -> Column:
    n = F.length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def words_with(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name): the words (word) that contain the names (name), both once each.

    A name of three letters or more meets the words by that of its pieces which
    the fewest words have; one without such words is nowhere.
    """
    words = words.select("word").distinct()
    pieces = words.select("word", F.explode(F.array_distinct(F.concat(*(_pieces(F.col("word"), k) for k in (1, 2, 3))))).alias("piece"))
    names = names.select("name").where(F.col("name").rlike(r"^\w+$")).distinct()
    own = names.select("name", F.explode(F.array_distinct(_pieces(F.col("name"), 3))).alias("piece")).unionByName(names.where(F.length("name") < 3).select("name", F.col("name").alias("piece")))
    counts = pieces.join(own.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("held"))
    rarest = own.join(counts, "piece", "left").groupBy("name").agg(F.min_by("piece", F.struct("held", "piece")).alias("piece"), F.bool_and(F.col("held").isNotNull()).alias("there")).where("there").drop("there")
    return pieces.join(rarest, "piece").where(F.contains("word", F.col("name"))).select("word", "name")


def _apart(left: Column, right: Column) -> Column:
    """Whether code of one language stands against code of another; other languages' code goes with anything."""
    return left.isNotNull() & ~left.eqNullSafe(right)


def import_edges(steps: DataFrame, components: DataFrame, words: DataFrame) -> DataFrame:
    """Steps (id, file) to the components (id, type, name, class_name, file, language) whose class they import: REFERENCES to pages, else CALLS."""
    named = words.where("kind = 'import'").select("file", F.col("language").alias("own"), F.col("word").alias("n"))
    c = components.select(F.col("id").alias("target_id"), "type", F.lower(F.coalesce("class_name", "name")).alias("n"), F.coalesce(_language("file"), F.lower("language")).alias("theirs"))
    found = steps.select(F.col("id").alias("source_id"), "file").join(named, "file").join(c, "n").where(~_apart(F.col("own"), F.col("theirs")))
    return found.select("source_id", "target_id", F.when(F.col("type") == "ui_page_object", "REFERENCES").otherwise("CALLS").alias("relationship")).distinct()


def _mentions(users: DataFrame, named: DataFrame, words: DataFrame) -> DataFrame:
    """(source_id, own, target_id, theirs, name) of users (id, file) whose file has a word that contains a name of named (target_id, theirs, name)."""
    said = words.where("kind = 'word'")
    hits = said.join(words_with(said, named), "word").select("file", F.col("language").alias("own"), "name").distinct()
    return users.select(F.col("id").alias("source_id"), "file").join(hits, "file").join(named, "name").select("source_id", "own", "target_id", "theirs", "name")


def mention_edges(steps: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """Steps (id, file) to the pages (id, class_name, file, framework) whose class, or it as a variable, their file mentions; not across languages."""
    name = F.col("class_name")
    camel = F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    frameworks = F.create_map(*(F.lit(x) for pair in FRAMEWORKS.items() for x in pair))
    named = pages.where((name != "") & ~F.lower(name).isin(*PLAIN_PAGES)).select(F.col("id").alias("target_id"), F.coalesce(_language("file"), F.element_at(frameworks, F.col("framework"))).alias("theirs"), F.explode(F.array_distinct(F.array(name, camel))).alias("name"))
    # Names of another language go before words and files meet: of a file's languages they are most.
    said = words.where("kind = 'word'")
    told = materialise(words_with(said, named).join(named.select("name", "theirs").distinct(), "name").groupBy("word").agg(F.collect_list(F.struct("name", F.col("theirs").alias("of"))).alias("names")))
    # What the commonest words tell is broadcast, so that a file's words stay together and its names, which many of them
    # tell, become distinct before they are shuffled.
    common = said.groupBy("word").agg(F.count("*").alias("held")).orderBy(F.desc("held"), "word").limit(COMMON).select("word")
    common = common.join(told, "word", "left")
    names = said.join(F.broadcast(materialise(common).withColumn("common", F.lit(True))), "word", "left")
    rare = names.where("common is null").select("file", "language", "word").join(told, "word").select("file", "language", "names")
    hits = names.where("names is not null").select("file", "language", "names").unionByName(rare).select("file", "language", F.explode("names").alias("n")).select("file", "language", "n.*")
    hits = hits.where(~_apart(F.col("language"), F.col("of"))).select("file", "name", "of").distinct()
    found = steps.select(F.col("id").alias("source_id"), "file").join(hits, "file").join(named.withColumnRenamed("name", "n"), (F.col("name") == F.col("n")) & F.col("of").eqNullSafe(F.col("theirs")))
    return found.select("source_id", "target_id", F.lit("REFERENCES").alias("relationship")).distinct()


def traced_edges(steps: DataFrame, calls: DataFrame, components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Steps that call (source_id, target_id) a component (id, file) to the endpoints (id, file) of its file, by TESTS."""
    c, e = components.select(F.col("id").alias("target_id"), "file").distinct(), endpoints.select(F.col("id").alias("endpoint_id"), "file").distinct()
    from_steps = calls.join(steps.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return from_steps.select("source_id", "target_id").join(c, "target_id").join(e, "file").select("source_id", F.col("endpoint_id").alias("target_id"), F.lit("TESTS").alias("relationship")).distinct()


def model_edges(steps: DataFrame, pages: DataFrame, scenarios: DataFrame, models: DataFrame, words: DataFrame) -> DataFrame:
    """USES of the models (id, class_name, language): by steps that build, make or (in TypeScript) type one, by pages that mention its class, by scenarios that do in any case.

    Code uses a model of another language only where its own has no model of that class.
    """
    suffix = F.when(F.endswith("id", F.lit("_java")), "java").when(F.endswith("id", F.lit("_ts")), "typescript")
    named = models.where("class_name != ''").select(F.col("id").alias("target_id"), F.coalesce(F.lower("language"), suffix).alias("theirs"), F.col("class_name").alias("name"))
    own = named.select(F.lower("name").alias("o_name"), F.col("theirs").alias("o_language")).distinct()

    def allowed(found: DataFrame) -> DataFrame:
        """Without what has a namesake in the code's own language."""
        apart = _apart(F.col("own"), F.col("theirs"))
        abroad = found.where(apart).join(own, (F.lower("name") == F.col("o_name")) & (F.col("own") == F.col("o_language")), "left_anti")
        return found.where(~apart).unionByName(abroad).select("source_id", "target_id")

    signs = words.where("kind != 'word' AND kind != 'import' AND (language = 'typescript' OR kind IN ('builder', 'made'))")
    held = signs.join(words_with(signs, named), "word")
    # Before `.builder()` a word ends with the class, behind `:` and `as` it begins with it, elsewhere it is the class.
    fits = F.when(F.col("kind") == "builder", F.endswith("word", F.col("name"))).when(F.col("kind").isin("typed", "cast"), F.startswith("word", F.col("name"))).otherwise(F.col("word") == F.col("name"))
    used = held.where(fits).select("file", F.col("language").alias("own"), "name").distinct()
    by_steps = allowed(steps.select(F.col("id").alias("source_id"), "file").join(used, "file").join(named, "name"))
    by_pages = allowed(_mentions(pages, named, words))
    said = scenarios.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "description")), F.lit(r"\w+"), 0))).alias("word"))
    low = named.select("target_id", F.lower("name").alias("name"))
    by_scenarios = said.join(words_with(said, low), "word").join(low, "name").select("source_id", "target_id")
    return by_steps.unionByName(by_pages).unionByName(by_scenarios).distinct().withColumn("relationship", F.lit("USES"))


def rule_edges(pages: DataFrame, rules: DataFrame, least: int = 2) -> DataFrame:
    """Pages to the rules, both (id, name, description), that share so many different words of three letters or more, by VALIDATES."""
    both = lambda df: df.select("id", F.concat_ws(" ", "name", "description").alias("text"))
    return overlapping(both(pages), both(rules), least).select("source_id", "target_id", F.lit("VALIDATES").alias("relationship"))
