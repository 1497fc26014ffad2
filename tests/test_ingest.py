"""A small mixed workspace from files to a linked graph."""

from loomgraph.plans.ingest import build
from loomgraph.sources import code_parsers, files, text_parsers

FILES = {
    "docs/rules.md": "# Feature: Flood cover\n## Rule: Deductible waiver flood zone\nThe deductible is waived when a flood zone is declared.\n",
    "features/flood.feature": "Feature: Floods\n  Scenario: Deductible waiver flood zone\n    Given deductible waived flood zone declared\n",
    "src/FloodController.java": '@RequestMapping("/api") public class FloodController { @GetMapping("/zones") void a() {} }',
    "api/spec.json": '{"paths": {"/api/zones/": {"get": {"summary": "zones", "responses": {"200": {}}}}}}',
    "conf/app.properties": "limit.days=60\n",
    "src/broken.py": "def (:",
    "node_modules/x.ts": "class X {}",
    "sheets/Codes.csv": "Code,Text\nA,b\n",
    "sheets/broken.xlsx": "no archive",
    "docs/scan.pdf": "%PDF-1.4 binary",
}


def test_workspace_to_graph(spark):
    table = spark.createDataFrame([(p, bytearray(t.encode()), str(hash(t))) for p, t in FILES.items()], "path string, content binary, checksum string")
    out = {k: [r.asDict() for r in df.collect()] for k, df in build(table).items()}
    ids = {n["id"] for n in out["nodes"]}
    assert {"feature_flood_cover", "rule_deductible_waiver_flood_zone", "scenario_deductible_waiver_flood_zone", "component_floodcontroller", "rule_constant_limit_days"} <= ids
    edges = {(e["source_id"], e["target_id"], e["relationship"]) for e in out["edges"]}
    assert ("scenario_deductible_waiver_flood_zone", "rule_deductible_waiver_flood_zone", "TESTS") in edges
    assert ("rule_deductible_waiver_flood_zone", "feature_flood_cover", "PART_OF") in edges
    assert [i for i in ids if i.startswith("endpoint_")] == ["endpoint_get_api_zones"]
    assert ("endpoint_get_api_zones", "component_floodcontroller", "IMPLEMENTS") in edges
    assert sorted(e["source_file"] for e in out["errors"]) == ["docs/scan.pdf", "sheets/broken.xlsx", "src/broken.py"] and "rule_codes" in ids
    assert {"file": "docs/rules.md", "node_id": "feature_flood_cover"} in out["claims"]


def test_updates_follow_priority_and_path(spark):
    """The last file by priority, then path, gives a node its description, whatever its name hashes to."""
    table = []
    for i in range(6):
        table += [(f"docs{i}/r.md", f"# Feature: F\n### Scenario: Case {i}\ntext of the page\n"), (f"src{i}/z.feature", f"Feature: G{i}\n  Scenario: Case {i}\n    Given a step\n")]
    # The same scenario in a page that comes after the feature file by path.
    table += [("zz/late.md", "### Scenario: Case 0\nthe last word\n")]
    out = build(spark.createDataFrame([(p, bytearray(t.encode()), "") for p, t in table], "path string, content binary, checksum string"))
    text = {n.id: n.description.strip() for n in out["nodes"].where("type = 'test_scenario'").collect()}
    assert text == {"scenario_case_0": "the last word"} | {f"scenario_case_{i}": "Given a step" for i in range(1, 6)}


def test_csv_sheets_and_agents(spark):
    table = spark.createDataFrame([("d/Codes.csv", bytearray(b"Code,Text\nA,\"x, y\"\n\nB,z\n"))], "path string, content binary")
    nodes = text_parsers.sheet_nodes(code_parsers.read_csv_sheets(table)).collect()
    assert [n.id for n in nodes] == ["rule_codes"] and "| A | x, y |" in nodes[0].description
    source = spark.createDataFrame([("a.ts", "page.locator('x')"), ("b.md", "")], "path string, text string")
    triggers = spark.createDataFrame([("pages", "ts", "locator"), ("docs", "md", None), ("sheets", "csv", None)], "agent string, ext string, pattern string")
    assert {r.agent for r in files.agents_for(source, triggers).collect()} == {"pages", "docs"}
