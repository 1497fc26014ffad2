"""Graphs that follow their files batch by batch, shards that merge, and the fold behind both."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import shared
from loomgraph.operators import fold, graph, merge
from loomgraph.plans import ingest, shards, state

UPDATE = "id string, ord long, type string, name string, description string, metadata string, origin string, source_file string, caller string"


def plain_fold(rows):
    """The rules of an update, one after the other."""
    out = {}
    for key, _, kind, name, text, meta, origin, file, caller in sorted(rows, key=lambda r: r[1]):
        meta, file, name, text = json.loads(meta) if meta else {}, file or "unknown", name or "", text or ""
        if key not in out:
            out[key] = {"type": kind, "name": name, "text": text, "meta": meta, "origin": origin, "files": {file}, "n": 1, "said": []}
            continue
        node = out[key]
        if node["origin"] == "documentation" and caller == "agent":
            node["said"] += [text[:200]] * (text[:200] not in node["said"])
            continue
        node["type"], node["origin"], node["n"] = kind, origin or node["origin"], node["n"] + 1
        node["name"] = name if len(name) > len(node["name"]) else node["name"]
        node["text"] = node["text"] if kind == "business_rule" and len(text) < len(node["text"]) else text
        node["files"].add(file)
        for k, v in meta.items():
            node["meta"][k] = {**node["meta"][k], **v} if isinstance(v, dict) and isinstance(node["meta"].get(k), dict) else v
    return {k: (v["type"], v["name"], v["text"], v["meta"], v["origin"] or "unknown", v["files"], v["n"] > 1, v["said"]) for k, v in out.items()}


def random_updates(seed):
    rng = random.Random(seed)
    values = [1, 2.5, "s", "{x}", None, True, [1, {"a": 1}], {}, {"p": 1}, {"p": 2}, {"q": "w", "r": {"deep": 1}}, {"r": {"other": 2}}, {"p": None}]
    out = []
    for place in range(500):
        meta = rng.choice([None, "{}", *(json.dumps({k: rng.choice(values) for k in rng.sample("klm", rng.randint(0, 3))}) for _ in range(8))])
        out.append((
            rng.choice("abcdefgh") + str(rng.randrange(6)), place, rng.choice(["business_rule"] * 3 + ["data_model"]), "n" * rng.randint(0, 5) + rng.choice("xyz"), rng.choice([None, "d" * rng.randint(0, 6) + rng.choice("uvw")]), meta,
            rng.choice([None, "code", "documentation", "unknown"]), rng.choice(["f1", "f2", "f3", None]), rng.choice(["parser", "agent", "agent", None]),
        ))
    return out


def test_fold_against_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(fold, "BAND", 16)
    rows = random_updates(7)
    got = {r.id: (r.type, r.name, r.description, json.loads(r.metadata), r.origin, set(r.source_origins), r.is_merged, r.anomalies) for r in merge.upsert_nodes(spark.createDataFrame(rows, UPDATE)).collect()}
    assert got == plain_fold(rows)


def test_pieces_merge_in_any_grouping(spark):
    taken, _ = fold.accepted(spark.createDataFrame(random_updates(8), UPDATE))
    single = graph.written(fold.pieces_of(taken).withColumn("part", F.floor(F.col("ord") / 25)))
    parts = graph.written(fold.combine(single, ("id", "part")))
    rows = lambda df: sorted(map(str, fold.nodes_of(df).collect()))
    assert rows(fold.combine(parts)) == rows(fold.combine(single))


def test_fold_of_no_rows_and_of_nulls(spark):
    assert merge.upsert_nodes(spark.createDataFrame([], UPDATE)).collect() == []
    row = merge.upsert_nodes(spark.createDataFrame([(None, 1, None, None, None, None, None, None, None), (None, 2, None, None, "x", '{"k": {"a": 1}}', None, None, None)], UPDATE)).head()
    assert (row.id, row.name, row.description, row.metadata, row.origin, row.source_origins, row.is_merged) == (None, "", "x", '{"k":{"a":1}}', "unknown", ["unknown"], True)


def test_types_reach_the_metadata(spark):
    rows = [("a", "claims", '{"x": 1}'), ("b", "security_rule", None), ("c", "security_rule", '{"rule_family": "own"}'), ("d", "data_model", '{"y": {"z": 1}}')]
    got = {r.id: (r.type, json.loads(r.metadata)) for r in merge.governed(spark.createDataFrame(rows, "id string, type string, metadata string")).collect()}
    assert got == {"a": ("business_rule", {"x": 1, "rule_category": "claims"}), "b": ("security_rule", {"rule_family": "business_rule"}), "c": ("security_rule", {"rule_family": "own"}), "d": ("data_model", {"y": {"z": 1}})}


EDGE = "source_id string, target_id string, relationship string, ord long, confidence double"


def test_edges_of_unknown_ends(spark):
    nodes, have = spark.createDataFrame([("a",), ("b",), (None,)], "id string"), spark.createDataFrame([("a", "b", "CALLS", 1, 1.0)], EDGE)
    new = spark.createDataFrame([("a", "b", "tests", 2, 0.5), ("a", "x", "TESTS", 3, 1.0), ("y", None, "TESTS", 4, 1.0)], EDGE)
    edges, refused, counts = graph.upsert_edges(have, new, nodes, "silent")
    assert [(r.relationship, r.ord) for r in edges.collect()] == [("TESTS", 2)] and counts == {"accepted": 1, "refused": 2}
    assert {(r.source_id, r.missing_source, r.missing_target) for r in refused.collect()} == {("a", False, True), ("y", True, True)}
    with pytest.raises(graph.MissingEnds, match="2 edges"):
        graph.upsert_edges(have, new, nodes, "raise")
    with pytest.raises(ValueError, match="silent"):
        graph.upsert_edges(have, new, nodes, "loud")


BASE = {
    "docs/rules.md": "# Feature: Flood cover\n## Rule: Deductible waiver flood zone\nThe deductible is waived when a flood zone is declared.\n",
    "features/flood.feature": "Feature: Floods\n  Scenario: Deductible waiver flood zone\n    Given deductible waived flood zone declared\n",
    "src/FloodController.java": '@RequestMapping("/api") public class FloodController { @GetMapping("/zones") void a() {} }',
    "conf/app.properties": "limit.days=60\n",
}
LATER = {
    "docs/more.md": "## Rule: Renewal notice letter\nA renewal notice letter is sent in time.\n## Rule: Deductible waiver flood zone\nAlso said here, at greater length than the other page has it, so that it stays.\n",
    "tests/LoginSteps.java": 'import app.pages.LoginPage;\nimport com.qmetry.qaf.X;\nclass LoginSteps { @QAFTestStep(description="user logs in") void a() { loginPage.open(); } }',
    "pages/LoginPage.java": "import com.qmetry.qaf.X;\nclass LoginPage extends WebDriverBaseTestPage { }",
}


def table(spark, files):
    return spark.createDataFrame([(p, bytearray(t.encode()), str(hash(t))) for p, t in sorted(files.items())], "path string, content binary, checksum string")


def plain(graph_):
    """Nodes and edges without what depends on places."""
    nodes = {(r.id, r.type, r.name, r.description, r.metadata, tuple(r.source_origins)) for r in graph_["nodes"].collect()}
    return nodes, {(r.source_id, r.target_id, r.relationship, r.confidence) for r in graph_["edges"].collect()}, {(r.file, r.node_id) for r in graph_["claims"].collect()}


def test_three_batches_and_a_build(spark, tmp_path):
    """Batches with changes and deletions end in the graph of the files that are left; a batch without changes reads no text."""
    folder, final = f"{tmp_path}/graph", {k: v for k, v in (BASE | LATER).items() if k != "conf/app.properties"}
    events = []
    hooks = state.Hooks()
    for event in ("before_ingest", "after_parse", "before_write", "after_ingest"):
        hooks.on(event, lambda e, _: events.append(e))
    first = state.update(table(spark, BASE | {"docs/rules.md": BASE["docs/rules.md"].replace("waived", "dropped")}), folder, hooks=hooks)
    assert (first["parsed_files"], first["nodes_removed"], first["batch"]) == (4, 0, 0) and events == ["before_ingest", "after_parse", "before_write", "after_ingest"]
    second = state.update(table(spark, BASE | LATER), folder)
    assert (second["parsed_files"], second["cached_files"], second["deleted_files"], second["batch"]) == (4, 3, 0, 1)
    idle = state.update(table(spark, BASE | LATER).withColumn("content", F.raise_error(F.lit("read"))), folder)
    assert (idle["parsed_files"], idle["cached_files"], idle["batch"]) == (0, 7, 1)
    third = state.update(table(spark, final), folder)
    assert (third["deleted_files"], third["nodes_removed"], third["batch"]) == (1, 1, 2)
    kept, built = state.State(spark, folder).graph(), ingest.build(table(spark, final))
    ours, theirs = plain(kept), plain(built)
    assert ours[0] == theirs[0] and ours[2] == theirs[2]
    # Scores keep the first batch's IDF; which edges there are is the same here.
    assert {e[:3] for e in ours[1]} == {e[:3] for e in theirs[1]}
    assert {("test_step_definition_user_logs_in", "ui_page_loginpage", "REFERENCES"), ("endpoint_get_api_zones", "component_floodcontroller", "IMPLEMENTS")} <= {e[:3] for e in ours[1]}
    text = {n[0]: n[3] for n in ours[0]}["rule_deductible_waiver_flood_zone"]
    assert "waived when" in text or "greater length" in text


def test_shards_merge_into_one_build(spark, tmp_path):
    files, root, folder = table(spark, BASE | LATER), f"{tmp_path}/shards", f"{tmp_path}/graph"
    for shard_id, include, exclude in (("code", ["src/*", "/pages/*"], []), ("docs", ["docs/*", "conf/*"], []), ("rest", [], ["src/*", "pages/*", "conf/*"])):
        shards.ingest_shard(files, root, shard_id, include, exclude)
    listed = {s["shard_id"]: (s["status"], s["file_count"]) for s in shards.list_shards(spark, root)}
    assert listed == {"code": ("completed", 2), "docs": ("completed", 3), "rest": ("completed", 4)}
    old = datetime.datetime.now(datetime.timezone.utc) - datetime.timedelta(hours=30)
    spark.createDataFrame([("late", old)], shards.STARTED).write.parquet(f"{root}/late/started")
    out = shards.merge_shards(spark, root, ["rest", "late", "docs", "code", "none"], folder)
    assert (out["shards_merged"], out["shards_failed"], out["nodes_removed"]) == (3, ["late", "none"], 0)
    state.fit_again(spark, folder)
    assert plain(state.State(spark, folder).graph()) == plain(ingest.build(files))
    assert [(s["shard_id"], s["status"]) for s in shards.list_shards(spark, root)] == [("late", "stale")]
    assert shards.clear_shards(spark, root) == ["late"] and shards.list_shards(spark, root) == []
    with pytest.raises(ValueError, match="named"):
        shards.ingest_shard(files, root, "../x", [])


def test_stream_of_files(spark, tmp_path):
    """Drops of files as a stream: changes and deletions take effect in the batch in which they come."""
    drops, counts = f"{tmp_path}/drops", []
    schema = "path string, content string, at long"
    for n, rows in enumerate([[(p, t, 1) for p, t in BASE.items()], [("conf/app.properties", "old", 1), ("conf/app.properties", None, 2), ("docs/rules.md", "# Feature: Flood cover\n", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{drops}/{n}")
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(drops)
        state.follow(events, f"{tmp_path}/graph", f"{tmp_path}/checkpoint", on_batch=counts.append).awaitTermination()
    assert [(c["parsed_files"], c["deleted_files"]) for c in counts] == [(4, 0), (1, 1)] and counts[1]["nodes_removed"] == 2
    ids = {r.id for r in state.State(spark, f"{tmp_path}/graph").of_nodes("nodes").collect()}
    assert "feature_flood_cover" in ids and "rule_constant_limit_days" not in ids and "rule_deductible_waiver_flood_zone" not in ids


def test_scopes_own_what_they_write(spark):
    with shared.scope(spark):
        outer = shared.materialise(spark.range(3))
        with shared.scope(spark):
            inner = shared.materialise(spark.range(2)).inputFiles()[0]
        left = outer.inputFiles()[0]
        assert not shared.exists(spark, inner) and shared.exists(spark, left) and outer.count() == 3
    assert not shared.exists(spark, left)


def test_metadata_folds_without_joining_updates_back(spark):
    """Members before a reset go, names are escaped, and no row of an update meets another in a join (there were two on every member)."""
    said = ['{"m": {"a": 1, "b": {"x": 1.5}}, "s": "1"}', '{"m": 7}', '{"m": {}, "s": {"q\\"\\u00e9": null}}', '{"m": {"c": [1, "y"]}}', '{"m": {"a": 2, "c": "z"}}', None]
    rows = [("n", i, "rule", "", "", text, None, "f") for i, text in enumerate(said)] + [("o", 0, "rule", "", "", '{"m": {"k": 1}}', None, "f"), ("o", 1, "rule", "", "", '{"m": {}}', None, "f")]
    pieces = fold.pieces_of(spark.createDataFrame(rows, "id string, ord bigint, type string, name string, description string, metadata string, origin string, source_file string"))
    got = {r.id: r.metadata for r in fold.nodes_of(fold.combine(pieces)).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {"n": {"m": {"a": 2, "c": "z"}, "s": {'q"\u00e9': None}}, "o": {"m": {"k": 1}}}
    apart = fold.combine(pieces.withColumn("part", F.floor(F.col("ord") / 2)), ("id", "part"))
    assert {r.id: r.metadata for r in fold.nodes_of(fold.combine(apart)).collect()} == got
    assert " Join " not in fold._metadata(pieces, ["id"], True)._jdf.queryExecution().optimizedPlan().toString()
