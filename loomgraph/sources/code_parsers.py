"""Parsers that need Python, run file by file inside mapInArrow.

Every parser is a function (path, content) -> (nodes, edges) of plain dicts;
parse_files() runs them over a table of files and keeps going past files that
fail, whose error is a row of its own.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship
from loomgraph.plans.schema import ID_PREFIX

Parsed = tuple[list[dict], list[dict]]
SCHEMA = "row string, id string, type string, name string, description string, source_file string, source_id string, target_id string, relationship string, metadata string"


def slug(text: str) -> str:
    bare = re.sub(r"^(rule|feature|scenario outline|scenario)[:\s]+", "", text.lower().strip())
    return re.sub(r"[^a-z0-9]+", "_", bare).strip("_")


def make_id(kind: str, name: str) -> str:
    return f"{ID_PREFIX.get(kind, kind)}_{slug(name)}"


def _node(kind: str, name: str, description: str, source_file: str, /, **metadata) -> dict:
    return {"id": make_id(kind, name), "type": kind, "name": name, "description": description, "source_file": source_file, "metadata": json.dumps(metadata, sort_keys=True)}


def _edge(source: str, target: str, relationship: str, **metadata) -> dict:
    return {"source_id": source, "target_id": target, "relationship": relationship, "metadata": json.dumps(metadata, sort_keys=True)}


def _text(content: bytes | str) -> str:
    return content if isinstance(content, str) else content.decode("utf-8", "ignore")


# --- Gherkin -----------------------------------------------------------------

_BLOCK = re.compile(r"^(Feature|Rule|Background|Scenario Outline|Scenario Template|Scenario|Example|Examples|Scenarios):\s*(.*)$")
_STEP = re.compile(r"^(Given|When|Then|And|But|\*)\s+(.*)$")


def _gherkin_blocks(text: str) -> Iterator[dict]:
    """Blocks in order: keyword, name, tags, steps and table rows."""
    tags: list[str] = []
    block: dict | None = None
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            tags += line.split()
            continue
        found = _BLOCK.match(line)
        if found:
            if block:
                yield block
            block = {"keyword": found[1], "name": found[2].strip(), "tags": tags, "steps": [], "table": [], "text": []}
            tags = []
        elif block is None:
            continue
        elif line.startswith("|"):
            block["table"].append([c.strip() for c in line.strip("|").split("|")])
        elif _STEP.match(line):
            block["steps"].append(line)
        else:
            block["text"].append(line)
    if block:
        yield block


def parse_gherkin(path: str, content: bytes | str) -> Parsed:
    """A feature, its scenarios (background steps first) and a scenario for each example row, numbered in each block."""
    nodes: list[dict] = []
    edges: list[dict] = []
    feature = rule = None
    shared: list[str] = []
    in_rule: list[str] = []
    outline: dict | None = None

    def scenario(block: dict, name: str, steps: list[str], suffix: str = "") -> None:
        node = _node("test_scenario", name, "\n".join(steps), path, tags=block["tags"])
        node["id"] += suffix
        nodes.append(node)
        if rule or feature:
            edges.append(_edge(node["id"], (rule or feature)["id"], "PART_OF"))
        for tag in block["tags"]:
            if tag.lower().startswith("@rule:"):
                edges.append(_edge(node["id"], make_id("business_rule", tag[6:]), "TESTS"))

    for block in _gherkin_blocks(_text(content)):
        kind = block["keyword"]
        if kind != "Examples" and kind != "Scenarios" and outline is not None:
            if not outline["used"]:
                scenario(outline, outline["name"], [*shared, *in_rule, *outline["steps"]])
            outline = None
        if kind == "Feature":
            feature = _node("product_feature", block["name"], "\n".join(block["text"]), path, tags=block["tags"])
            nodes.append(feature)
        elif kind == "Rule":
            rule, in_rule = _node("business_rule", block["name"], "\n".join(block["text"]), path), []
            nodes.append(rule)
            if feature:
                edges.append(_edge(rule["id"], feature["id"], "PART_OF"))
        elif kind == "Background":
            if rule:
                in_rule = block["steps"]
            else:
                shared = block["steps"]
        elif kind in ("Scenario Outline", "Scenario Template"):
            outline = {**block, "used": False}
        elif kind in ("Examples", "Scenarios") and outline is not None:
            outline["used"] = True
            head, *rows = block["table"] or [[]]
            for n, row in enumerate(rows, 1):
                fill = lambda s, row=row, head=head: _substitute(s, dict(zip(head, row)))
                scenario(outline, fill(outline["name"]), [fill(s) for s in (*shared, *in_rule, *outline["steps"])], f"_ex{n}")
        elif kind in ("Scenario", "Example"):
            scenario(block, block["name"], [*shared, *in_rule, *block["steps"]])
    if outline is not None and not outline["used"]:
        scenario(outline, outline["name"], [*shared, *in_rule, *outline["steps"]])
    return nodes, edges


def _substitute(text: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        text = text.replace(f"<{name}>", value)
    return text


# --- OpenAPI -----------------------------------------------------------------

_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def _model_name(reference: str) -> str:
    return reference.rsplit("/", 1)[-1]


def _references(value: object) -> Iterator[str]:
    if isinstance(value, dict):
        if isinstance(value.get("$ref"), str):
            yield _model_name(value["$ref"])
        for inner in value.values():
            yield from _references(inner)
    elif isinstance(value, list):
        for inner in value:
            yield from _references(inner)


def _properties(schema: object, models: dict, seen: frozenset = frozenset()) -> dict[str, str]:
    """Names and types of a schema's properties, through references and allOf, oneOf and anyOf."""
    if not isinstance(schema, dict):
        return {}
    out: dict[str, str] = {}
    reference = schema.get("$ref")
    if isinstance(reference, str) and reference not in seen:
        out |= _properties(models.get(_model_name(reference)), models, seen | {reference})
    for key in ("allOf", "oneOf", "anyOf"):
        for part in schema.get(key) or []:
            out |= _properties(part, models, seen)
    for name, inner in (schema.get("properties") or {}).items():
        out[name] = inner.get("type") or _model_name(inner.get("$ref", "object")) if isinstance(inner, dict) else "any"
    return out


def parse_schema(path: str, content: bytes | str) -> Parsed:
    """Endpoints, models and USES_MODEL of an API description; any other object is one model."""
    data = _load(_text(content))
    if not isinstance(data, dict):
        return [], []
    models = (data.get("components") or {}).get("schemas") or data.get("definitions") or {}
    nodes: list[dict] = []
    edges: list[dict] = []
    for name, schema in models.items():
        title = schema.get("title", name) if isinstance(schema, dict) else name
        nodes.append(_node("data_model", name, str(title), path, properties=_properties(schema, models)))
    for route, operations in (data.get("paths") or {}).items():
        for method, operation in (operations or {}).items():
            if method.lower() not in _METHODS or not isinstance(operation, dict):
                continue
            node = _node("api_endpoint", f"{method.upper()} {route}", operation.get("summary") or operation.get("description") or "", path, http_method=method.upper(), path=route, responses=sorted(map(str, operation.get("responses") or {})))
            nodes.append(node)
            edges += [_edge(node["id"], make_id("data_model", m), "USES_MODEL") for m in sorted(set(_references(operation)))]
    if not nodes:
        nodes.append(_node("data_model", data.get("title") or re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1]), "", path, properties={k: type(v).__name__ for k, v in data.items()}))
    return nodes, edges


# --- Source code -------------------------------------------------------------


def _endpoint(method: str, route: str, source_file: str, /, **metadata) -> dict:
    route = re.sub(r"/{2,}", "/", "/" + route)
    return _node("api_endpoint", f"{method.upper()} {route}", "", source_file, http_method=method.upper(), path=route, **metadata)


def _bare(source: str) -> str:
    return re.sub(r"//[^\n]*", "", re.sub(r"/\*.*?\*/", "", source, flags=re.S))


def parse_java(path: str, content: bytes | str) -> Parsed:
    """Classes, endpoints mapped by annotations under the class's base route, and IMPLEMENTS from endpoint to class."""
    source = _bare(_text(content))
    found = re.search(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:public\s+|final\s+|abstract\s+)*(?:class|interface)\s+(\w+)", source)
    if not found:
        return [], []
    utility = bool(re.search(r"(Util|Utils|Helper)$", found[2]))
    owner = _node("test_utility" if utility else "code_component", found[2], "", path, language="java")
    base = re.search(r"@RequestMapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"([^\"]*)\"", found[1])
    nodes, edges = [owner], []
    for kind, arguments in re.findall(r"@(Get|Post|Put|Delete|Patch)Mapping(?:\(([^)]*)\))?", source[found.end() :]):
        route = re.search(r"\"([^\"]*)\"", arguments or "")
        node = _endpoint(kind, f"{base[1] if base else ''}/{route[1] if route else ''}".rstrip("/"), path, class_name=found[2])
        nodes.append(node)
        edges.append(_edge(node["id"], owner["id"], "IMPLEMENTS"))
    return nodes, edges


def parse_typescript(path: str, content: bytes | str) -> Parsed:
    """Classes and decorated controllers' endpoints; also app.get('/..') and router.post('/..') calls."""
    source = _bare(_text(content))
    nodes = [_node("test_utility" if re.search(r"(Util|Utils|Helper)$", name) else "code_component", name, "", path, language="typescript") for name in dict.fromkeys(re.findall(r"\bclass\s+(\w+)", source))]
    base = re.search(r"@Controller\(\s*['\"`]([^'\"`]*)['\"`]", source)
    for kind, route in re.findall(r"@(Get|Post|Put|Delete|Patch)\(\s*(?:['\"`]([^'\"`]*)['\"`])?\s*\)", source):
        nodes.append(_endpoint(kind, f"{base[1] if base else ''}/{route}".rstrip("/"), path))
    for kind, route in re.findall(r"\b(?:app|router)\.(get|post|put|delete|patch)\(\s*['\"`]([^'\"`]+)['\"`]", source):
        nodes.append(_endpoint(kind, route, path))
    return nodes, []


def parse_python(path: str, content: bytes | str) -> Parsed:
    """Routes of decorated functions: @app.get('/..'), @router.post('/..'), @app.route('/..', methods=[..])."""
    nodes = []
    for function in ast.walk(ast.parse(_text(content))):
        if not isinstance(function, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        for d in function.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant)):
                continue
            methods = [d.func.attr]
            if d.func.attr == "route":
                given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                methods = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["get"]
            nodes += [_endpoint(m, str(d.args[0].value), path, function=function.name) for m in methods if m.lower() in _METHODS]
    return nodes, []


def parse_go(path: str, content: bytes | str) -> Parsed:
    source = _bare(_text(content))
    nodes = [_endpoint(m, r, path) for m, r in re.findall(r"\.(GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"", source)]
    return nodes + [_endpoint("get", r, path) for r in re.findall(r"\bHandleFunc\(\s*\"([^\"]+)\"", source)], []


def parse_playwright(path: str, content: bytes | str) -> Parsed:
    """Page objects with locators (BINDS_LOCATOR), step definitions (USES_POM) and interfaces."""
    source = _text(content)
    nodes: list[dict] = []
    edges: list[dict] = []
    for name, body in re.findall(r"class\s+(\w*(?:Page|POM)\w*)[^{]*\{(.*?)(?=\nclass\s|\nexport\s+class\s|\Z)", source, re.S):
        page = _node("ui_page_object", name, "", path, class_name=name, framework="playwright")
        nodes.append(page)
        for field, selector in re.findall(r"(\w+)\s*=\s*(?:this\.)?page\.(?:locator|getBy\w+)\(\s*['\"`]([^'\"`]+)['\"`]", body):
            node = _node("ui_locator", f"{name}.{field}", selector, path, selector=selector)
            nodes.append(node)
            edges.append(_edge(page["id"], node["id"], "BINDS_LOCATOR"))
    pages = set(re.findall(r"new\s+(\w*(?:Page|POM)\w*)\(", source)) | set(re.findall(r"import\s*\{?\s*(\w*(?:Page|POM)\w*)", source))
    for keyword, pattern in re.findall(r"\b(Given|When|Then)\(\s*['\"`/]([^'\"`\n]+?)['\"`/]\s*,", source):
        node = _node("test_step_definition", f"{keyword} {pattern}", pattern, path)
        nodes.append(node)
        edges += [_edge(node["id"], make_id("ui_page_object", p), "USES_POM") for p in sorted(pages)]
    for name, body in re.findall(r"\binterface\s+(\w+)[^{]*\{([^}]*)\}", source):
        nodes.append(_node("data_model", name, "", path, class_name=name, language="typescript", properties=dict(re.findall(r"(\w+)\??\s*:\s*([\w\[\]<>|. ]+)", body))))
    return nodes, edges


def parse_qaf(path: str, content: bytes | str) -> Parsed:
    """Scenarios of .bdd files; page objects, steps, models and REST calls of Java ones; configuration of property files."""
    source = _text(content)
    nodes: list[dict] = []
    if path.endswith(".bdd"):
        for name, body in re.findall(r"(?ms)^SCENARIO:\s*(.+?)$(.*?)^END\s*$", source):
            steps = [s.strip() for s in body.splitlines() if _STEP.match(s.strip())]
            nodes.append(_node("test_scenario", name.strip(), "\n".join(steps), path))
    elif path.endswith(".java"):
        for name, parent in re.findall(r"class\s+(\w+)(?:\s+extends\s+(\w+))?", _bare(source)):
            kind = "ui_page_object" if "Page" in (parent or "") else "data_model" if "DataBean" in (parent or "") else "test_utility" if re.search(r"(Util|Utils|Helper)$", name) else "code_component"
            nodes.append(_node(kind, name, "", path, class_name=name, language="java"))
        nodes += [_node("test_step_definition", text, text, path) for text in re.findall(r"@QAFTestStep\(\s*description\s*=\s*\"([^\"]+)\"", source)]
        nodes += [_endpoint(m, re.sub(r"^\w+://[^/]+", "", r), path) for m, r in re.findall(r"\.(get|post|put|delete|patch)\(\s*\"([^\"]*/[^\"]*)\"", source)]
    else:
        pairs = dict(re.findall(r"(?m)^\s*([\w.]+)\s*=\s*(.+?)\s*$", source))
        kind = "ui_page_object" if re.search("locator|selector", path, re.I) or path.endswith(".loc") else "data_model"
        listing = "\n".join(f"{k}={v}" for k, v in sorted(pairs.items())[:30])
        nodes.append(_node(kind, re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1]), listing, path, entries=pairs))
    return nodes, []


# --- Office documents ----------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def word_paragraphs(content: bytes) -> list[tuple[int, str]]:
    """(heading level or 0, text) of a .docx body; a table is one paragraph in Markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    out = []
    for part in body if body is not None else []:
        if part.tag == f"{_W}tbl":
            rows = [[" ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")).split()) for cell in row.iter(f"{_W}tc")] for row in part.iter(f"{_W}tr")]
            out.append((0, "\n".join("| " + " | ".join(r) + " |" for r in rows)))
        elif part.tag == f"{_W}p":
            style = part.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            out.append((int(level[1]) if level else 0, "".join(t.text or "" for t in part.iter(f"{_W}t"))))
    return out


def parse_word(path: str, content: bytes) -> Parsed:
    """Sections by headings: rules by keyword, else features; sections of fewer than 30 characters are left out."""
    nodes: list[dict] = []
    edges: list[dict] = []
    above: dict[int, str] = {}
    current: tuple[int, str, list[str]] | None = None

    def close() -> None:
        if current is None or len("\n".join(current[2]).strip()) < 30:
            return
        level, heading, texts = current
        rule = any(w in heading.lower() for w in ("rule", "validation", "requirement", "constraint"))
        body = "\n".join(texts).strip()
        nfr = bool(re.search(r"(?i)non.?functional|performance|availability", heading))
        node = _node("business_rule" if rule else "product_feature", heading, body if len(body) <= 1000 else body[:1000] + "...", path, rule_origin="nfr" if nfr else "functional")
        nodes.append(node)
        parent = next((above[i] for i in range(level - 1, 0, -1) if i in above), None)
        above[level] = node["id"]
        for deeper in [i for i in above if i > level]:
            del above[deeper]
        if parent and parent != node["id"]:
            edges.append(_edge(node["id"], parent, "PART_OF"))

    for level, text in word_paragraphs(content):
        if level:
            close()
            current = (level, text.strip(), [])
        elif current is not None and not re.fullmatch(r"(?i)\s*(page\s+)?\d+(\s*(of|/)\s*\d+)?\s*", text):
            current[2].append(text)
    close()
    return nodes, edges


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells as text) of an .xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        files = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in files:
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        out = []
        for n, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
            if f"xl/worksheets/sheet{n}.xml" not in files:
                continue
            rows = []
            for row in ElementTree.fromstring(archive.read(f"xl/worksheets/sheet{n}.xml")).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for i, cell in enumerate(row.iter(f"{_S}c")):
                    letters = re.match(r"[A-Z]+", cell.get("r", ""))
                    at = i
                    if letters:
                        at = 0
                        for letter in letters[0]:
                            at = at * 26 + ord(letter) - 64
                        at -= 1
                    value = cell.find(f"{_S}v")
                    text = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                    cells[at] = shared[int(text)] if cell.get("t") == "s" and text else text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name", f"sheet{n}"), rows))
    return out


SHEET_SCHEMA = "path string, sheet string, headers array<string>, rows array<array<string>>, error string"


def read_sheets(files: DataFrame) -> DataFrame:
    """(path, sheet, headers, rows, error) of .xlsx files (path, content); see text_parsers.sheet_nodes()."""
    ship(files.sparkSession)

    kind = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch.to_pylist():
                try:
                    found += [{"path": file["path"], "sheet": name, "headers": rows[0], "rows": rows[1:]} for name, rows in sheets(file["content"]) if rows]
                except Exception as problem:  # a broken file must not stop the job
                    found.append({"path": file["path"], "error": f"{type(problem).__name__}: {problem}"[:500]})
            yield pa.RecordBatch.from_pylist(found, kind)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SHEET_SCHEMA)


def read_csv_sheets(files: DataFrame) -> DataFrame:
    """(path, sheet, headers, rows, error) of .csv files (path, content), one sheet each."""
    ship(files.sparkSession)
    kind = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch.to_pylist():
                try:
                    rows = [r for r in csv.reader(io.StringIO(_text(file["content"]))) if any(r)]
                except csv.Error as problem:
                    found.append({"path": file["path"], "error": f"{type(problem).__name__}: {problem}"[:500]})
                    continue
                if rows:
                    found.append({"path": file["path"], "sheet": re.sub(r"\.\w+$", "", file["path"].rsplit("/", 1)[-1]), "headers": rows[0], "rows": rows[1:]})
            yield pa.RecordBatch.from_pylist(found, kind)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SHEET_SCHEMA)


PARSERS: dict[str, Callable[[str, bytes], Parsed]] = {
    "gherkin": parse_gherkin, "schema": parse_schema, "java": parse_java, "typescript": parse_typescript, "python": parse_python, "go": parse_go, "playwright": parse_playwright, "qaf": parse_qaf, "word": parse_word,
}
#: Kinds that other functions read.
ELSEWHERE = ("markdown", "properties", "pdf", "excel", "csv")


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of kind node, edge or error from files (path, kind, content)."""
    ship(files.sparkSession)
    kind = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for file in batch.to_pylist():
                if file["kind"] in ELSEWHERE:
                    continue
                parser = PARSERS.get(file["kind"])
                if parser is None:
                    out.append({"row": "error", "source_file": file["path"], "description": f"no parser for {file['kind']}"})
                    continue
                try:
                    nodes, edges = parser(file["path"], file["content"])
                    out += [{"row": "node", **n} for n in nodes] + [{"row": "edge", "source_file": file["path"], **e} for e in edges]
                except Exception as problem:  # a broken file must not stop the job
                    out.append({"row": "error", "source_file": file["path"], "description": f"{type(problem).__name__}: {problem}"[:500]})
            yield pa.RecordBatch.from_pylist(out, kind)

    return files.select("path", "kind", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)
