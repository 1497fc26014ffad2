"""All inferred edges of a graph: term similarity, shared names, classes and the structure of test code.

A mapper is a function (nodes, edges, policy, words) -> rows (source_id,
target_id, relationship, score, tokens, mapper); MAPPERS is open for more.  Nodes
carry id, type, name, description, source_origins, and where known rule_origin,
path, class_name, language, framework.  words are those of framework.words_of();
without them, the mappers that read code give nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import framework, similarity, structural
from loomgraph.operators.graph import existing_edges, written
from loomgraph.plans.schema import AUTO_EMIT, CANDIDATE, DOMAIN_STOPWORDS, GENERIC_STOPWORDS, RULE_FAMILY, type_allowed

#: What is scored: relationship, types of the source and of the target.
SCORED = (
    ("TESTS", ("test_scenario",), RULE_FAMILY), ("IMPLEMENTS", ("api_endpoint",), RULE_FAMILY), ("IMPLEMENTS", ("api_endpoint",), ("product_feature",)), ("VALIDATES", ("ui_page_object",), ("business_rule", "ui_business_rule")),
)
NAME_SCORE = 0.75
Mapper = Callable[[DataFrame, DataFrame, DataFrame, DataFrame | None], DataFrame]
#: Mappers that read what code says; the policy's pairs of types bind only those that guess.
READING = ("imports", "mentions", "traces", "models", "rules")


def _limits(policy: DataFrame) -> DataFrame:
    return policy.groupBy("relationship").agg(F.max("min_score").alias("limit"))


def scored(left: DataFrame, right: DataFrame, pairs: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What SCORED asks for of two weight tables with type and origin; pairs(left, right) finds pairs of them.

    Nodes stand once for each relationship that their type may have, ids and terms
    marked with its number, so that one search finds the pairs of all of them.
    Relationships that no node of left may begin are left out.
    """
    begins = {t for _, s, _ in SCORED for t in s}
    there = {r.type for r in left.where(F.col("type").isin(*begins)).select("type").distinct().collect()}

    def marked(weights: DataFrame, kinds: list[tuple[str, ...]]) -> DataFrame:
        marks = F.filter(F.array(*(F.when(F.col("type").isin(*k), F.lit(str(i)) if there & set(SCORED[i][1]) else F.lit(None).cast("string")) for i, k in enumerate(kinds))), lambda m: m.isNotNull())
        return weights.withColumn("m", F.explode(marks)).withColumn("id", F.concat("m", "id")).withColumn("term", F.concat("m", "term")).drop("m")

    found = pairs(marked(left, [s for _, s, _ in SCORED]), marked(right.where("origin != 'nfr'"), [t for _, _, t in SCORED]))
    names = F.array(*(F.lit(r) for r, _, _ in SCORED))
    bare = lambda c: F.substring(c, F.lit(2), F.length(c))
    return found.select(bare("source_id").alias("source_id"), bare("target_id").alias("target_id"), F.get(names, F.substring("source_id", 1, 1).cast("int")).alias("relationship"), "score", F.transform("tokens", bare).alias("tokens"), F.lit("terms").alias("mapper"))


def marked_ids(ids: DataFrame) -> DataFrame:
    """The ids (id) as scored() marks them."""
    return ids.select(F.explode(F.array(*(F.concat(F.lit(str(i)), F.col("id")) for i in range(len(SCORED))))).alias("id"))


def with_kind(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    return weights.join(nodes.select("id", "type", F.coalesce("rule_origin", F.lit("functional")).alias("origin")), "id")


def node_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.concat_ws(" ", "name", "description").alias("text"))


def by_terms(nodes: DataFrame, edges: DataFrame, policy: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Cosine over name and description; statistics cover all nodes, rules that are not functional stay out."""
    postings = similarity.term_table(node_text(nodes))
    w = with_kind(similarity.weights(postings, similarity.idf_table(postings, nodes.count())), nodes)
    return scored(w, w, lambda a, b: similarity.cosine_pairs(a, b, CANDIDATE))


def by_names(nodes: DataFrame, edges: DataFrame, policy: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Scenarios to endpoints that share a word of the name; administration and reset endpoints only where the scenario speaks of them."""
    stop = F.array(*map(F.lit, (*GENERIC_STOPWORDS, *DOMAIN_STOPWORDS, "get", "post", "put", "delete", "patch", "api")))
    endpoints = nodes.where("type = 'api_endpoint'")
    pairs = similarity.shared_name_words(nodes.where("type = 'test_scenario'"), endpoints, stop)
    guarded = endpoints.where(similarity.is_admin_route()).select(F.col("id").alias("target_id"), F.lit(True).alias("guarded"))
    words = F.lower(F.concat_ws(" ", "name", "description"))
    said = nodes.select(F.col("id").alias("source_id"), (F.contains(words, F.lit("admin")) | F.contains(words, F.lit("reset"))).alias("said"))
    kept = pairs.join(guarded, "target_id", "left").join(said, "source_id").where(F.col("guarded").isNull() | F.col("said"))
    return kept.select("source_id", "target_id", F.lit("TESTS").alias("relationship"), F.lit(NAME_SCORE).alias("score"), "tokens", F.lit("names").alias("mapper"))


def by_classes(nodes: DataFrame, edges: DataFrame, policy: DataFrame, words: DataFrame | None = None) -> DataFrame:
    found = structural.class_endpoint_edges(nodes.where("type = 'api_endpoint' and class_name is not null"), nodes.where("type = 'code_component'"))
    return found.select("source_id", "target_id", "relationship", F.col("confidence").alias("score"), F.array().cast("array<string>").alias("tokens"), F.lit("classes").alias("mapper"))


def _placed(nodes: DataFrame, *kinds: str) -> DataFrame:
    """The nodes of these types once for each of their files, with `file`."""
    return nodes.where(F.col("type").isin(*kinds)).withColumn("file", F.explode("source_origins"))


def _read(found: DataFrame, mapper: str) -> DataFrame:
    return found.select("source_id", "target_id", "relationship", F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("tokens"), F.lit(mapper).alias("mapper"))


COMPONENTS = ("code_component", "test_utility", "ui_page_object")


def by_code(nodes: DataFrame, edges: DataFrame, policy: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """What steps and pages import, mention, test and use, as their files' words say; calls that are stored count with those found."""
    rules = _read(framework.rule_edges(nodes.where("type = 'ui_page_object'"), nodes.where("type = 'business_rule'")), "rules")
    if words is None:
        return rules
    steps, components, pages = _placed(nodes, "test_step_definition"), _placed(nodes, *COMPONENTS), _placed(nodes, "ui_page_object")
    imports = framework.import_edges(steps, components, words)
    calls = edges.where("upper(relationship) = 'CALLS'").select("source_id", "target_id").unionByName(imports.where("relationship = 'CALLS'").select("source_id", "target_id")).distinct()
    traces = framework.traced_edges(steps, calls, components, _placed(nodes, "api_endpoint"))
    models = framework.model_edges(steps, pages, nodes.where("type = 'test_scenario'"), nodes.where("type = 'data_model'"), words)
    mentions = framework.mention_edges(steps, pages, words)
    return rules.unionByName(_read(imports, "imports")).unionByName(_read(mentions, "mentions")).unionByName(_read(traces, "traces")).unionByName(_read(models, "models"))


MAPPERS: list[Mapper] = [by_terms, by_names, by_classes, by_code]


def infer(nodes: DataFrame, edges: DataFrame, policy: DataFrame, mappers: list[Mapper] | None = None, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new edges, candidates below their limit): best score of each pair and relationship whose types the policy allows, without edges that exist.

    Edges that are read from code (READING) are facts, which no pair of types keeps out.
    """
    out = None
    for mapper in mappers or MAPPERS:
        rows = mapper(nodes, edges, policy, words)
        out = rows if out is None else out.unionByName(rows)
    best = out.groupBy("source_id", "target_id", "relationship").agg(F.max_by(F.struct("score", "tokens", "mapper"), F.struct("score", "mapper")).alias("b")).select("source_id", "target_id", "relationship", "b.*")
    read = F.col("mapper").isin(*READING)
    kinds = nodes.select("id", "type")
    typed = best.join(kinds.select(F.col("id").alias("source_id"), F.col("type").alias("src_type")), "source_id").join(kinds.select(F.col("id").alias("target_id"), F.col("type").alias("tgt_type")), "target_id")
    allowed = typed.where(read).unionByName(type_allowed(typed.where(~read), policy)).drop("src_type", "tgt_type")
    fresh = existing_edges(edges, allowed, negate=True)
    limited = fresh.join(F.broadcast(_limits(policy)), "relationship", "left").withColumn("limit", F.coalesce("limit", F.lit(AUTO_EMIT)))
    found = written(limited.where(F.col("score") >= F.least("limit", F.lit(CANDIDATE))).withColumn("emit", F.col("score") >= F.col("limit")).drop("limit"))
    return found.where("emit").drop("emit"), found.where(~F.col("emit") & (F.col("score") >= CANDIDATE)).drop("emit")
