"""Vocabularies, the edge policy and table schemas of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Types, relationships, thresholds and words that results depend on.
RULE_FAMILY = ("business_rule", "validation_rule", "eligibility_rule", "ui_business_rule", "security_rule")
TRAVERSABLE = ("TESTS", "IMPLEMENTS", "MAPS_TO", "CALLS", "REFERENCES", "TRACES_TO", "DECLARES")
AUTO_EMIT, CANDIDATE = 0.75, 0.35
MIN_SCORE = {"TESTS": 0.65, "IMPLEMENTS": 0.70, "VALIDATES": 0.70, "USES_MODEL": 0.95, "MAPS_TO": 0.60, "REFERENCES": 0.70, "CALLS": 0.75, "USES_DATA": 0.60}
TYPE_PAIRS = {
    "TESTS": [*(("test_scenario", t) for t in RULE_FAMILY), ("test_scenario", "api_endpoint")],
    "IMPLEMENTS": [*(("code_component", t) for t in RULE_FAMILY if t != "security_rule"), ("code_component", "test_scenario"), ("api_endpoint", "business_rule"), ("api_endpoint", "product_feature"), ("api_endpoint", "code_component")],
    "VALIDATES": [("business_rule", "data_model"), ("validation_rule", "data_model"), ("ui_page_object", "business_rule"), ("ui_page_object", "ui_business_rule"), ("data_model", "validation_rule"), ("data_model", "eligibility_rule"), ("data_model", "business_rule")],
    "USES_MODEL": [("api_endpoint", "data_model")],
    "MAPS_TO": [*(("field_specification", t) for t in RULE_FAMILY), *(("rule_constant", t) for t in RULE_FAMILY if t != "ui_business_rule"), ("ui_element", "field_specification"), ("ui_element", "ui_business_rule")],
    "REFERENCES": [("ui_page_object", "ui_element"), ("test_scenario", "ui_element"), ("code_component", "test_utility")],
    "CALLS": [("code_component", "test_utility"), ("test_utility", "test_utility")],
    "USES_DATA": [("test_scenario", "data_model")],
}
DOMAIN_STOPWORDS = (
    "policy policies coverage coverages claim claims premium premiums rule rules test tests scenario scenarios endpoint endpoints "
    "request response feature features user users data model service controller handler client config context value field input "
    "output system process step steps"
).split()
GENERIC_STOPWORDS = "the and for with that this from must should will have has had when then given but are was were been being".split()
ID_PREFIX = {
    "business_rule": "rule", "product_feature": "feature", "api_endpoint": "endpoint", "code_component": "component", "data_model": "schema", "test_scenario": "scenario", "test_utility": "util",
    "claims": "rule", "billing": "rule", "access_control": "rule", "enrollment": "rule", "non_functional": "rule", "validation_rule": "rule", "eligibility_rule": "rule", "ui_business_rule": "rule",
    "security_rule": "rule", "field_specification": "field_spec", "ui_page_object": "ui_page", "ui_element": "ui_element", "rule_constant": "rule_constant",
}
CATEGORY_TYPES = ("claims", "billing", "access_control", "enrollment", "non_functional")
# End of the fixed values.

NODE_SCHEMA = "id string, type string, name string, description string, ord bigint, metadata string"
EDGE_SCHEMA = "source_id string, target_id string, relationship string, ord bigint, confidence double, source string, metadata string"


def policy_table(spark: SparkSession, min_scores: dict[str, float] | None = None, extra_pairs: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """(relationship, min_score, src_type, tgt_type): given entries win, missing relationships are filled from the defaults."""
    scores = MIN_SCORE | (min_scores or {})
    pairs = TYPE_PAIRS | (extra_pairs or {})
    rows = [(r, float(max(scores.get(r, 0.0), AUTO_EMIT)), a, b) for r, ps in pairs.items() for a, b in ps]
    return spark.createDataFrame(rows, "relationship string, min_score double, src_type string, tgt_type string")


def type_allowed(pairs: DataFrame, policy: DataFrame) -> DataFrame:
    """Pairs (relationship, src_type, tgt_type, ..) that the policy allows; a relationship that it does not name is free."""
    named = policy.select(F.col("relationship").alias("r")).distinct()
    allowed = policy.select(F.col("relationship").alias("r"), F.col("src_type").alias("s"), F.col("tgt_type").alias("t")).distinct()
    free = pairs.join(F.broadcast(named), F.col("relationship") == F.col("r"), "left_anti")
    held = pairs.join(F.broadcast(allowed), (F.col("relationship") == F.col("r")) & (F.col("src_type") == F.col("s")) & (F.col("tgt_type") == F.col("t")), "left_semi")
    return free.unionByName(held)
