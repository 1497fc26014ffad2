"""Parsers, graph files, sinks and incremental ingest on small files."""

import io
import json
import zipfile

from loomgraph.operators import provenance
from loomgraph.sources import api_schemas
from loomgraph.sources import code_parsers as P
from loomgraph.sources import files as W
from loomgraph.sources import graph_file, text_parsers
from loomgraph.streaming.ingest import Hooks, parse_changed, stream

FEATURE = """@billing
Feature: Flood cover
  Background:
    Given a policy
  @rule:waiver
  Scenario: Waived
    When it floods
  Scenario Outline: Limit <n>
    Then pay <n>
    Examples:
      | n |
      | 1 |
      | 2 |
    Examples: more
      | n |
      | 3 |
"""


def test_gherkin():
    nodes, edges = P.parse_gherkin("a.feature", FEATURE)
    names = [n["id"] for n in nodes]
    assert names == ["feature_flood_cover", "scenario_waived", "scenario_limit_1_ex1", "scenario_limit_2_ex2", "scenario_limit_3_ex1"]
    assert nodes[1]["description"] == "Given a policy\nWhen it floods"
    assert ("scenario_waived", "rule_waiver", "TESTS") in {(e["source_id"], e["target_id"], e["relationship"]) for e in edges}


def test_markdown(spark):
    text = "# Feature: Cover\nintro\n## Rule: Limits\nbody\n### Scenario: Over\nx\n## Purpose\n### Alone\ny"
    nodes, edges = text_parsers.markdown(spark.createDataFrame([("m.md", text)], "path string, text string"))
    assert {r.id for r in nodes.collect()} == {"feature_cover", "rule_limits", "scenario_over", "scenario_alone"}
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {("rule_limits", "feature_cover"), ("scenario_over", "rule_limits"), ("scenario_alone", "feature_cover")}


def test_openapi():
    spec = {"paths": {"/pets": {"get": {"responses": {"200": {"content": {"x": {"schema": {"$ref": "#/components/schemas/Pet"}}}}}}}}, "components": {"schemas": {"Pet": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"properties": {"name": {"type": "string"}}}]}, "Base": {"properties": {"id": {"type": "integer"}}}}}}
    nodes, edges = P.parse_schema("api.json", json.dumps(spec))
    pet = next(n for n in nodes if n["name"] == "Pet")
    assert json.loads(pet["metadata"])["properties"] == {"id": "integer", "name": "string"}
    assert [(e["source_id"], e["target_id"]) for e in edges] == [("endpoint_get_pets", "schema_pet")]


def test_code():
    java = '@RestController @RequestMapping("/api") public class PetController { @GetMapping("/pets") void a(){} @PostMapping void b(){} }'
    nodes, edges = P.parse_java("P.java", java)
    assert [n["name"] for n in nodes] == ["PetController", "GET /api/pets", "POST /api"] and len(edges) == 2
    ts = "@Controller('pets') export class PetsController { @Get(':id') one() {} }\napp.get('/x', f)"
    assert [n["name"] for n in P.parse_typescript("p.ts", ts)[0]] == ["PetsController", "GET /pets/:id", "GET /x"]
    py = "@app.route('/a', methods=['GET', 'POST'])\ndef a(): ...\n@router.delete('/b')\nasync def b(): ..."
    assert [n["name"] for n in P.parse_python("p.py", py)[0]] == ["GET /a", "POST /a", "DELETE /b"]
    assert [n["name"] for n in P.parse_go("m.go", 'r.GET("/a", f)\nhttp.HandleFunc("/b", g)')[0]] == ["GET /a", "GET /b"]


def test_test_frameworks():
    ts = "export class LoginPage { user = this.page.locator('#user'); }\nGiven('I log in', async () => { new LoginPage(page); });\ninterface User { name: string; }"
    nodes, edges = P.parse_playwright("steps.ts", ts)
    assert {n["type"] for n in nodes} == {"ui_page_object", "ui_locator", "test_step_definition", "data_model"}
    assert {e["relationship"] for e in edges} == {"BINDS_LOCATOR", "USES_POM"}
    assert P.parse_qaf("a.bdd", "SCENARIO: One\nGiven a\nThen b\nEND\n")[0][0]["description"] == "Given a\nThen b"
    assert P.parse_qaf("S.java", '@QAFTestStep(description = "log in") class Login extends BasePage {}')[0][0]["type"] == "ui_page_object"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    body = p("Cover", "Heading1") + p("What is covered and what is not covered.") + p("Rule of limits", "Heading2") + p("A limit of 10 applies to each claim made.") + p("Tiny", "Heading2") + p("Page 3 of 9")
    nodes, edges = P.parse_word("a.docx", _zip({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"}))
    assert [n["type"] for n in nodes] == ["product_feature", "business_rule"] and len(edges) == 1
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    head = ["Field ID", "Field Name", "Type", "Length"]
    rows = [head, *([f"F{i}", f"Name {i}", "text", "5"] for i in range(10))]
    sheet = "".join("<row>" + "".join(f'<c r="{"ABCD"[j]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    xlsx = _zip({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Fields"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData>{sheet}</sheetData></worksheet>"})
    table = P.read_sheets(spark.createDataFrame([("f.xlsx", bytearray(xlsx))], "path string, content binary"))
    out = text_parsers.sheet_nodes(table).orderBy("id").collect()
    assert len(out) == 10 and out[0].id == "field_spec_f0" and out[0].name == "Field Spec: Name 0"


def test_properties_sheets_and_locators(spark):
    text = "# c\n! d\na=true\nb = 12\nc: 1.5\nd=x,y\ne=plain\nb = 13\n"
    got = {r.name: (r.value_type, r.raw_value, r.times) for r in text_parsers.properties(spark.createDataFrame([("p.properties", text)], "path string, text string")).collect()}
    assert got == {"a": ("boolean", "true", 1), "b": ("integer", "13", 2), "c": ("float", "1.5", 1), "d": ("list", "x,y", 1), "e": ("string", "plain", 1)}
    known = text_parsers.locators(spark.createDataFrame([("l.loc", "login.user=#user\nlogin.user=#u2")], "path string, text string"))
    used = spark.createDataFrame([("p", "login.user"), ("p", "none")], "page_id string, key string")
    assert {r.key: r.selector for r in text_parsers.bind_locators(used, known).collect()} == {"login.user": "#u2", "none": "unresolved"}
    long = "1. Premium formula\n" + "x" * 40 + "\n2. Other part\nshort"
    assert [r.type for r in text_parsers.document_sections(spark.createDataFrame([("d.pdf", long)], "path string, text string")).collect()] == ["business_rule"]


def test_workspace_routing_standards(spark):
    rows = [("a/node_modules/x.ts", ""), ("b/login.locators.properties", "x=1"), ("c/a.feature", ""), ("c/LoginPage.ts", ""), ("d/T.java", "    int someValue = otherValue;\n"), ("d/x.bin", "")]
    files = W.eligible(spark.createDataFrame(rows, "path string, text string"))
    got = {r.path: (r.priority, r.kind) for r in files.withColumn("kind", W.parser_kind()).collect()}
    assert got == {"b/login.locators.properties": (0, "qaf"), "c/a.feature": (1, "gherkin"), "c/LoginPage.ts": (2, "typescript"), "d/T.java": (3, "java")}
    row = W.standards(files).head()
    assert (row.indentation, row.naming_convention) == ("4_spaces", "camelCase")
    manifest = spark.createDataFrame([("x/package.json", '{"devDependencies": {"@playwright/test": "1", "jest": "2"}}')], "path string, text string")
    assert {r.framework for r in W.frameworks(manifest).collect()} == {"playwright", "jest"}
    got = W.standards_for(files.select("path"), [("d/*.java", "java style"), ("c/", "page style")], "default")
    assert {r.standard for r in got.collect()} == {"java style", "page style", "default"}


def test_graph_files_and_store(spark, tmp_path):
    graph = {"schema_version": 2, "payload": {"nodes": {"r1": {"type": "business_rule", "name": "R"}, "s1": {"id": "s1", "type": "test_scenario"}}, "edges": [], "links": [{"source": "s1", "target_id": "r1", "type": "TESTS"}]}}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges = graph_file.read_graph(spark, str(tmp_path / "g.json"))
    assert {r.id for r in nodes.collect()} == {"r1", "s1"}
    assert [(r.source_id, r.target_id, r.relationship) for r in edges.collect()] == [("s1", "r1", "TESTS")]
    store = graph_file.GraphStore(spark, str(tmp_path / "store"))
    assert store.save(nodes, edges) == 1 and store.save(nodes.limit(1), edges) == 2
    assert store.load()[0].count() == 1
    assert json.loads(graph_file.to_node_link(nodes, edges))["edges"][0]["source_id"] == "s1"
    assert graph_file.migrate({"links": [1]}, 1) == {"edges": [1]}
    rows = spark.createDataFrame([('a "q"', "x\ny"), ("b", "")], "t string, u string")
    graph_file.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == 't,u\n"a ""q""","x\ny"\nb,\n'


def test_incremental_batch_and_stream(spark, tmp_path):
    files = spark.createDataFrame([("a.feature", bytearray(FEATURE.encode()), "c1"), ("b.py", bytearray(b"def (:"), "c2"), ("c.py", bytearray(b"@app.get('/x')\ndef f(): ..."), "c3")], "path string, content binary, checksum string")
    indexed = spark.createDataFrame([("a.feature", "c1"), ("c.py", "old")], "path string, checksum string")
    events = []
    hooks = Hooks()
    hooks.on("before_ingest", lambda *e: events.append(e[0]))
    hooks.on("before_ingest", lambda *e: 1 / 0)
    rows = parse_changed(indexed, files, hooks).collect()
    assert {(r.row, r.source_file) for r in rows} == {("error", "b.py"), ("node", "c.py")} and events == ["before_ingest"]
    assert {(r.path, r.status) for r in provenance.sync_report(indexed, files).collect()} == {("a.feature", "synced"), ("b.py", "new"), ("c.py", "modified")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.feature").write_text(FEATURE)
    run = lambda: stream(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/b.py").write_text("@app.get('/x')\ndef f(): ...")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).where("row = 'node'").count() == 6


def test_routes_of_a_long_file_read_each_mark_once(spark):
    """Bases, spans and brackets in a row; no frame reaches up to the end of the file for each mark (one did, quadratic in a file's marks)."""
    from loomgraph.sources import routes

    one = '@RequestMapping("/b%d")\n@Tag("x")\npublic class C%d {{ ;;\n @GetMapping("/g") String a() { return x; }\n @RequestMapping(value = "/r", method = RequestMethod.PUT) String b() {{}}\n}}\n@GetMapping("/lost")\nclass D%d { @PostMapping String c() {} }\n'
    files = spark.createDataFrame([("A.java", '@GetMapping("/none") ;' + "".join(one % (i, i, i) for i in range(300))), ("E.java", None)], "path string, content string")
    got = {tuple(r) for r in routes.endpoints(files).collect()}
    want = {("A.java", None, "GET", "/none")}
    for i in range(300):
        want |= {("A.java", f"C{i}", "GET", f"/b{i}/g"), ("A.java", f"C{i}", "PUT", f"/b{i}/r"), ("A.java", f"D{i}", "POST", "/")}
    assert got == want
    assert "RowFrame, 1, unboundedfollowing" not in routes.endpoints(files)._jdf.queryExecution().analyzed().toString()


def test_schemas_are_read_once_however_long_references_go(spark, monkeypatch):
    ref = lambda n: {"$ref": f"#/components/schemas/S{n}"}
    specs = {f"S{n}": {"allOf": [ref(n + 1), {"oneOf": [{"properties": {"p": {"type": f"t{n}"}, f"p{n}": True}}]}]} for n in range(6)}
    specs["S6"] = ref(0) | {"anyOf": [{"properties": {"p": {"type": "last"}}}], "properties": {"end": ref(2), "none": {}}}
    rows = [("a", n, json.dumps(s)) for n, s in specs.items()] + [("b", "S1", "true"), ("b", "S0", json.dumps(specs["S0"])), ("a", "S3", json.dumps(specs["S3"])), (None, "S0", json.dumps(specs["S0"])), ("a", None, json.dumps(ref(6))), ("a", "T", None)]
    asked, written = [], api_schemas.written
    monkeypatch.setattr(api_schemas, "written", lambda df: asked.append(df.columns) or written(df))
    got = {tuple(r) for r in api_schemas.flat_properties(spark.createDataFrame(rows, "path string, name string, schema string")).collect()}
    every = {(f"p{n}", "any") for n in range(6)} | {("end", "S2"), ("none", "object")}
    # The cycle goes once around: of each model, its own place for p is the last, and S6 has its own part.
    want = {("a", f"S{n}", *p) for n in range(7) for p in every | {("p", f"t{n}" if n < 6 else "last")}}
    want |= {("a", None, *p) for p in every | {("p", "last")}} | {(path, "S0", *p) for path in ("b", None) for p in (("p", "t0"), ("p0", "any"))}
    assert got == want
    assert sum("schema" in columns for columns in asked) <= 4
