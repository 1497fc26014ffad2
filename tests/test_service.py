"""Envelopes, repairs, blueprints and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import repair
from loomgraph.operators import blueprint, coverage
from loomgraph.service import Fault, Registry, Workspace, inside


@pytest.fixture()
def workspace(spark):
    nodes = spark.createDataFrame([("r", "business_rule", "Flood rule", "waives deductible", 1), ("s", "test_scenario", "Flood", "deductible", 2), ("x", "api_endpoint", "Renew", "post", 3)], "id string, type string, name string, description string, ord long")
    edges = spark.createDataFrame([("s", "r", "TESTS", 1, 0.9)], "source_id string, target_id string, relationship string, ord long, confidence double")
    return Workspace(nodes, edges)


def test_calls_answer_in_envelopes(workspace, spark):
    assert {r["type"]: r["n"] for r in workspace.summary()["data"]["nodes"]}[None] == 3
    assert [r["id"] for r in workspace.search("renew")["data"]] == ["x"]
    assert len(workspace.search("")["data"]) == 3
    trace = workspace.trace("r")["data"]
    assert {n["id"] for n in trace["nodes"]} == {"r", "s"} and len(trace["edges"]) == 1 and not trace["truncated"]
    assert workspace.trace("r", max_nodes=1)["data"]["truncated"]
    assert workspace.trace("none")["error"]["code"] == "NODE_NOT_FOUND"
    assert workspace.add_edge("x", "none", "IMPLEMENTS")["ok"] is False and workspace.add_edge("x", "r", "IMPLEMENTS")["ok"]
    assert workspace.edges.count() == 2 and workspace.validate()["data"]["is_valid"]
    proposals = spark.createDataFrame([("x", "s", "TESTS", 0.9, ""), ("x", "s", None, 0.9, ""), ("x", "q", "TESTS", 0.9, ""), ("x", "s", "TESTS", 0.1, "")], "source_id string, target_id string, relationship string, confidence double, rationale string")
    assert workspace.propose(proposals)["data"] == {"accepted": 1, "no relationship": 1, "no target": 1, "low confidence": 1}
    assert workspace.save()["error"]["code"] == "WORKSPACE_NOT_FOUND"


def test_registry_and_paths(workspace, spark, tmp_path):
    registry = Registry(spark)
    with pytest.raises(Fault):
        registry.get()
    registry.add(str(tmp_path), workspace)
    assert registry.get() is workspace is registry.get(str(tmp_path))
    assert inside("a/../b", str(tmp_path)) == str(tmp_path.resolve() / "b")
    with pytest.raises(Fault):
        inside("../b", str(tmp_path))


def test_json_out_of_noise(spark):
    noisy = 'Here it is:\n```json\n{"a": "}", "b": [1, 2]}\n```\nGood luck {'
    assert repair.extract_json(noisy) == '{"a": "}", "b": [1, 2]}'
    assert repair.parse_output('{"rows": [{"x": 1}, {"y": [2]}}') == {"rows": [{"x": 1}, {"y": [2]}]}
    assert repair.close_lists("{broken") == "{broken" and repair.extract_json("none") == "none" and repair.extract_json('x {"a": 1') == '{"a": 1'
    assert repair.numbers_as_text({"attribute_values": {"a": 1, "b": True}, "possible_values": [1.5], "n": 3}) == {"attribute_values": {"a": "1", "b": "true"}, "possible_values": ["1.5"], "n": 3}
    rows = spark.createDataFrame([(noisy,), ("no",), (None,)], "raw string").select(repair.mended_json("raw").alias("j")).collect()
    assert [r.j for r in rows] == ['{"a": "}", "b": [1, 2]}', None, None]


def test_blueprints(spark):
    code = spark.createDataFrame([("u", "java", "public static String pick(int a, String b) {} public void main(String[] x) {}"), ("p", "python", "def load(path):\n  pass")], "utility_id string, language string, content string")
    assert {(r.utility_id, r.name, r.parameters) for r in blueprint.methods(code).collect()} == {("u", "pick", "int a, String b"), ("p", "load", "path")}
    assert blueprint.locator_priority(spark.createDataFrame([("page.getByRole('x')",)], "selector string")).head()[0][0] == "getByRole"
    assert blueprint.locator_priority(spark.createDataFrame([("#x",)], "selector string")).head()[0][0] == "id"
    assert code.select(blueprint.template_of(F.lit("class A extends B {}"), F.lit("A"))).head()[0] == "class ${className} extends B {}"
    old = spark.createDataFrame([("u", "U.java", ["a"]), ("v", "V.java", ["b"])], "utility_id string, source_file string, methods array<string>")
    fresh = spark.createDataFrame([("u", "U.java", ["c"])], old.schema)
    kept = blueprint.register(old, fresh, spark.createDataFrame([("U.java",)], "path string"))
    assert [(r.utility_id, r.method) for r in blueprint.reusable_methods(kept).collect()] == [("u", "c")]


def test_contracts(spark):
    rules = spark.createDataFrame([("lifecycle", True, False), ("binary_flag", True, True), ("other", True, True)], "rule_type string, has_limit boolean, has_status boolean")
    assert [len(r.methodologies) for r in coverage.methodologies(rules).collect()] == [5, 3, 0]
    kinds = spark.createDataFrame([("security_rule", "three attempts"), ("validation_rule", "at least 3"), ("business_rule", "x")], "type string, description string").select(coverage.default_rule_type().alias("t"))
    assert [r.t for r in kinds.collect()] == ["lifecycle", "numeric_threshold", None]
    analysis = spark.createDataFrame([("r", ["EP"], ["EP"], ["age", "zone"])], "rule_id string, applicable array<string>, skipped array<string>, attributes array<string>")
    classes = spark.createDataFrame([("r", "age", True), ("r", "age", False), ("r", "other", True)], "rule_id string, attribute string, is_straight_through boolean")
    assert coverage.analysis_violations(analysis, classes).count() == 3
    logs = spark.createDataFrame([(True, []), (True, ["g"]), (False, ["g"]), (False, [])], "is_compliant boolean, gaps array<string>")
    assert [r[0] for r in logs.select(coverage.gap_log_is_consistent()).collect()] == [True, False, True, False]
    history = coverage.loop_history(spark.createDataFrame([(1, 5), (2, 1)], "iteration int, gaps int")).head()
    assert (history.iterations, history.resolved) == (2, 4)
    block = coverage.constraint_block(spark.createDataFrame([("b", "60 days"), ("a", "18")], "rule_id string, constraint string")).head()[0]
    assert block == "- a: 18\n- b: 60 days"
    metrics = coverage.metrics(spark.createDataFrame([("r",)], "id string"), spark.createDataFrame([("c", 1)], "category_id string, total_conditions_count int"), spark.createDataFrame([("r", "c", 2)], "target_rule_id string, category_id string, n_steps int"))
    matrix = spark.createDataFrame([("r", "s", "None Linked")], "rule_id string, scenarios string, technical string")
    assert "| r | s | None Linked |" in coverage.report_markdown(metrics, matrix, spark.createDataFrame([], "id string"))
