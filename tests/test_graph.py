"""Small graphs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import coverage, framework, graph, merge, planning, provenance, search, similarity, structural


def chain(spark, k, confidence=1.0):
    nodes = spark.createDataFrame([(f"n{i}", "business_rule") for i in range(k)], "id string, type string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "IMPLEMENTS", i, confidence) for i in range(k - 1)], "source_id string, target_id string, relationship string, ord long, confidence double")
    return nodes, edges


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_bounded_search_depth_and_cap(spark):
    nodes, edges = chain(spark, 10)
    assert ids(graph.neighbourhood(edges, nodes, "n5", 1)) == {"n4", "n5", "n6"}
    assert ids(graph.neighbourhood(edges, nodes, "n5", 2)) == {"n3", "n4", "n5", "n6", "n7"}
    capped = graph.neighbourhood(edges, nodes, "n5", 4, max_nodes=3)
    assert capped.count() == 3 and "n5" in ids(capped)
    assert graph.neighbourhood(edges, nodes, "none", 2).count() == 0


def test_confidence_floor_and_missing_confidence(spark):
    nodes = spark.createDataFrame([("r",), ("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("r", "a", "TESTS", 1, None), ("r", "b", "TESTS", 2, 0.3)], "source_id string, target_id string, relationship string, ord long, confidence double")
    assert ids(graph.neighbourhood(edges, nodes, "r", 2, floor=0.5)) == {"r", "a"}


def test_reachability_both_ways_and_one_way(spark):
    nodes, edges = chain(spark, 4)
    seeds = nodes.where("id = 'n1'")
    assert ids(graph.reachable(edges, seeds)) == {"n0", "n1", "n2", "n3"}
    assert ids(graph.reachable(edges, seeds, both_ways=False)) == {"n1", "n2", "n3"}
    other = edges.withColumn("relationship", F.lit("PART_OF"))
    assert ids(graph.reachable(other, seeds)) == {"n1"}


def test_validation(spark):
    nodes, edges = chain(spark, 3)
    good = graph.validate(nodes, edges).head()
    assert good.is_valid and good.warnings == ["no scenario", "no endpoint"]
    bad = graph.validate(nodes.where("id != 'n2'"), edges).head()
    assert not bad.is_valid and bad.dangling_preview == ["n2"]


def _weights(spark, docs):
    table = spark.createDataFrame(docs, "id string, text string")
    postings = similarity.term_table(table)
    return similarity.weights(postings, similarity.idf_table(postings, len(docs)))


def test_cosine_identical_disjoint_and_subset(spark):
    w = _weights(spark, [("a", "flood deductible waiver"), ("b", "flood deductible waiver"), ("c", "renewal notice letter"), ("d", "flood deductible waiver renewal"), ("e", "the and for")])
    score = {(r.source_id, r.target_id): r.score for r in similarity.cosine_pairs(w, w, 0.01).collect()}
    assert score["a", "b"] == pytest.approx(1) and ("a", "c") not in score and score["a", "d"] > 0.75
    assert score["a", "d"] == pytest.approx(score["d", "a"]) and not any("e" in k for k in score)


def test_cosine_twins_equal_brute_force_and_vectors_travel_to_cells(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)]
    near = [(f"n{i}", " ".join(words[:60] + words[100 + i : 104 + i])) for i in range(40)]
    far = [(f"f{i}", " ".join(words[150 + 3 * i : 162 + 3 * i])) for i in range(40)]
    w = _weights(spark, near + far + [(f"c{i}", near[0][1]) for i in range(20)] + [("e", "the and")]).cache()
    docs = {}
    for r in w.collect():
        docs.setdefault(r.id, {})[r.term] = r.idf
    norm = {k: sum(v * v for v in d.values()) for k, d in docs.items()}
    dots = {(a, b): sorted((-x, t) for t, x in docs[a].items() if t in docs[b]) for a in docs for b in docs if a < b}
    want = {k: (sum(x * x for x, _ in v) / math.sqrt(norm[k[0]] * norm[k[1]]), [t for _, t in v[:5]]) for k, v in dots.items()}
    for floor in (0.35, 0.74):
        got = {(r.source_id, r.target_id): (r.score, r.tokens) for r in similarity.cosine_twins(w, floor).collect()}
        right = {k: v for k, v in want.items() if v[0] >= floor}
        assert set(got) == set(right) and len(got) > 1000 and all(got[k] == (pytest.approx(v[0]), v[1]) for k, v in right.items())
    pairs = spark.createDataFrame([(a, b) for a, _ in near for b, _ in near if a < b], "source_id string, target_id string")
    cells = similarity._in_cells(pairs, lambda ids: ids, None).select(F.sum(F.size("pairs")).alias("pairs"), F.sum(F.size("xs")).alias("moved")).head()
    assert cells.pairs == 780 and cells.moved < 200


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x z z"), ("c", "w")], "id string, text string")
    got = {r.id: r.score for r in search.bm25(docs, ["z"]).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got == {"b": pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))}
    # A term of two of three documents has a negative IDF and takes a share of the mean.
    mean = (2 * idf + idf + (math.log(1.5) - math.log(2.5))) / 4
    assert {r.id: r.score for r in search.bm25(docs, ["x"]).collect()}["a"] == pytest.approx(0.25 * mean * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)))


def _updates(spark, rows):
    return spark.createDataFrame(rows, "id string, ord long, type string, name string, description string, metadata map<string,string>, origin string, source_file string, caller string")


def test_upsert_rules(spark):
    rows = [
        ("a", 1, "business_rule", "Long name", "a long description", {"k": "1", "l": "x"}, "code", "f1", "parser"),
        ("a", 2, "business_rule", "Short", "short", {"k": "2"}, None, "f2", "parser"),
        ("b", 1, "business_rule", "B", "documented", {}, "documentation", "d.md", "parser"),
        ("b", 2, "business_rule", "B", "an agent's view", {}, "code", "f3", "agent"),
    ]
    got = {r.id: r for r in merge.upsert_nodes(_updates(spark, rows)).collect()}
    assert got["a"].name == "Long name" and got["a"].description == "a long description"
    assert got["a"].metadata == {"k": "2", "l": "x"} and got["a"].origin == "code" and got["a"].source_origins == ["f1", "f2"] and got["a"].is_merged
    assert got["b"].description == "documented" and got["b"].anomalies == ["an agent's view"] and not got["b"].is_merged


def test_types_collapse(spark):
    got = {r.id: (r.type, r.rule_category, r.rule_family) for r in merge.normal_types(spark.createDataFrame([("a", "claims"), ("b", "security_rule"), ("c", "data_model")], "id string, type string")).collect()}
    assert got == {"a": ("business_rule", "claims", "business_rule"), "b": ("security_rule", None, "business_rule"), "c": ("data_model", None, None)}


def test_coverage_numbers(spark):
    rules = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    categories = spark.createDataFrame([("happy_path", 3), ("boundary_limit", 5)], "category_id string, total_conditions_count int")
    tests = spark.createDataFrame([("r1", "happy_path", 2)] * 4 + [("r1", "boundary_limit", 2)] * 2, "target_rule_id string, category_id string, n_steps int")
    row = coverage.metrics(rules, categories, tests).head()
    assert (row.rule_coverage, row.condition_coverage, row.total_tests, row.steps_per_test) == (33.3, 62.5, 6, 2.0)
    empty = coverage.metrics(rules.limit(0), categories.limit(0), tests.limit(0)).head()
    assert (empty.rule_coverage, empty.condition_coverage, empty.steps_per_test) == (0, 0, 0)


def test_linear_expansion_counts(spark):
    rows = [("r", "age", i, str(i), i == 0) for i in range(3)] + [("r", "zone", i, f"z{i}", i == 0) for i in range(2)]
    out = coverage.linear_expansion(spark.createDataFrame(rows, "rule_id string, attribute string, ord int, value string, is_baseline boolean")).orderBy("test_number").collect()
    assert [r.test_number for r in out] == [1, 2, 3, 4] and out[0]["values"] == {"age": "0", "zone": "z0"} and out[3]["values"] == {"age": "0", "zone": "z1"}


def test_slugs_and_sequence_go_on(spark):
    names = spark.createDataFrame([("Resume Application Portal",), ("A",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(coverage.feature_slug("n")).collect()] == ["RAPEPOSPRULT", "AXX", "FEATURE", "FEATURE"]
    tests = spark.createDataFrame([("RAP", "happy_path", 1), ("RAP", "happy_path", 2)], "slug string, category_id string, ord int")
    counters = spark.createDataFrame([("RAP", "HP", 7)], "slug string, kind string, last int")
    assert [r.tc_id for r in coverage.test_ids(tests, counters).orderBy("ord").collect()] == ["TC_RAP_HP_008", "TC_RAP_HP_009"]


def test_provenance(spark):
    claims = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "b")], "file string, node_id string")
    left, orphans = provenance.forget(claims, spark.createDataFrame([("f1",)], "file string"))
    assert ids(orphans, "node_id") == {"a"} and left.count() == 1


def test_endpoint_duplicates(spark):
    rows = [("long_id", "/a/b", "get", False, 1), ("id", "A-B/", "GET", False, 2), ("spec", "/a/c", "GET", True, 3), ("s", "/a/c/", "GET", False, 1), ("x", "/a/c", "POST", False, 4)]
    got = {r.id: r.primary for r in merge.duplicate_endpoints(spark.createDataFrame(rows, "id string, path string, http_method string, has_spec boolean, ord long")).collect()}
    assert got == {"long_id": "id", "id": "id", "spec": "spec", "s": "spec"}


def test_structural_edges(spark):
    files = spark.createDataFrame([("s", "typescript", "import { LoginPage, Db as D } from './x';\nnew LoginPage(); User"), ("j", "java", "import com.acme.TokenUtil;")], "id string, language string, content string")
    parts = spark.createDataFrame([("p", "LoginPage", "code_component", "javascript"), ("u", "TokenUtil", "test_utility", "java"), ("w", "TokenUtil", "test_utility", "go")], "id string, name string, type string, language string")
    got = {(r.source_id, r.target_id, r.relationship) for r in structural.import_edges(files, parts).collect()}
    assert got == {("s", "p", "REFERENCES"), ("j", "u", "CALLS")}
    named = structural.class_endpoint_edges(spark.createDataFrame([("e", "Login")], "id string, class_name string"), parts.select("id", "name"))
    assert ids(named, "target_id") == {"p"}
    models = spark.createDataFrame([("m1", "User", "java"), ("m2", "User", "typescript"), ("m3", "LoginPage", "java")], "id string, name string, language string")
    assert {(r.source_id, r.target_id) for r in structural.model_usage(files, models).collect()} == {("s", "m2"), ("s", "m3")}


def test_packing_and_merging():
    assert planning.pack([("a", 5), ("b", 4), ("c", 3), ("d", 2)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert planning.merge_smallest([("a", 1), ("b", 2), ("c", 9)], 2) == [("a_and_b", 3), ("c", 9)]


def test_loop_states_and_first_step(spark):
    it = spark.createDataFrame([(1, 5), (2, 3), (3, 3)], "iteration int, gaps int")
    assert [r.state for r in coverage.loop_state(it).orderBy("iteration").collect()] == ["continue", "continue", "divergence"]
    steps = spark.createDataFrame([([(1, "Verify the sum", "ok")],)], "steps array<struct<step_number:int,action:string,expected:string>>")
    row = steps.select(coverage.asserts_in_first_step(F.col("steps")).alias("a"), coverage.with_setup_step(F.col("steps")).alias("s")).head()
    assert row.a and [s.step_number for s in row.s] == [1, 2]


def test_class_counts_equal_the_edges(spark):
    """One count for each endpoint, of one class or several, as many as it has edges; equal classes are looked for once."""
    endpoints = spark.createDataFrame([("e1", "a"), ("e2", "a"), ("e3", "ab"), ("e3", "ba"), ("e4", "Login"), ("e5", "zzz"), ("e6", ""), ("e7", None)], "id string, class_name string")
    parts = spark.createDataFrame([("p1", "aba"), ("p2", "cab"), ("p2", "xba"), ("p3", "MyLoginImpl"), ("p4", ""), ("p5", None)], "id string, name string")
    edges = structural.class_endpoint_edges(endpoints, parts).groupBy("source_id").count().collect()
    counts = {r.source_id: r.n for r in structural.class_endpoint_counts(endpoints, parts).collect()}
    assert counts == {r["source_id"]: r["count"] for r in edges} == {"e1": 2, "e2": 2, "e3": 2, "e4": 1}


def test_words_of_a_long_text_are_distinct_by_kind(spark):
    """30,000 different words in one text, which took minutes when they were compared pair by pair."""
    import time

    text = " ".join(f"w{i}" for i in range(30_000)) + " User.builder() new User( User"
    files = spark.createDataFrame([("a.ts", text)], "path string, content string")
    began = time.monotonic()
    rows = [(r.kind, r.word) for r in framework.words_of(files).collect()]
    assert time.monotonic() - began < 60
    assert len(rows) == len(set(rows)) and ("builder", "User") in rows and ("made", "User") in rows and ("word", "w29999") in rows


def test_ends_that_are_no_node_are_split_off(spark, monkeypatch):
    """Null ends too, and with ids that are too many to be broadcast."""
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x")], "id string, type string")
    edges = spark.createDataFrame([("a", "b", 0), ("a", "z", 1), ("z", "b", 2), (None, "b", 3), ("a", None, 4), ("z", None, 5)], "source_id string, target_id string, ord long")
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        whole, bad = graph.split_edges(edges, nodes)
        assert {r.ord for r in whole.collect()} == {0} == {r.ord for r in graph.rooted_edges(edges, nodes).collect()}
        assert {(r.ord, r.missing_source, r.missing_target) for r in bad.collect()} == {(1, False, True), (2, True, False), (3, True, False), (4, False, True), (5, True, True)}


def test_steps_are_the_same_whether_the_frontier_is_broadcast(spark, monkeypatch):
    nodes, edges = chain(spark, 6)
    seeds = nodes.where("id = 'n2'")
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert {r.id for r in graph.reachable(edges, seeds, nodes=nodes).collect()} == {f"n{i}" for i in range(6)}
        assert {r.id for r in graph.neighbourhood(edges, nodes, "n2", 2).collect()} == {f"n{i}" for i in range(5)}


def test_equal_lists_of_words_meet_once(spark):
    """Rows with the same words, in any order, have the pairs of their list of words."""
    left = spark.createDataFrame([("l1", "red big car"), ("l2", "car red big"), ("l3", "red"), ("l4", "big old car"), ("l5", None)], "id string, text string")
    right = spark.createDataFrame([("r1", "big car"), ("r2", "car, big"), ("r3", "red old")], "id string, text string")
    got = {(r.source_id, r.target_id): r.shared for r in similarity.overlapping(left, right).collect()}
    assert got == {(s, t): 2 for s in ("l1", "l2", "l4") for t in ("r1", "r2")}


@pytest.mark.parametrize("common", [1, 3, 100])
def test_mentions_are_the_same_whichever_words_are_broadcast(spark, monkeypatch, common):
    monkeypatch.setattr(framework, "COMMON", common)
    texts = {"a.java": "LoginPage x x loginPageOne", "b.ts": "x CartPage cartPages LoginPage", "c.py": "CartPage theLoginPage x", "d.py": "x"}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    steps = files.select(F.concat(F.lit("s_"), "path").alias("id"), F.col("path").alias("file"))
    pages = spark.createDataFrame([("p1", "LoginPage", "p.java", None), ("p2", "CartPage", "q.ts", None), ("p3", "NowherePage", "r", None)], "id string, class_name string, file string, framework string")
    got = {(r.source_id, r.target_id) for r in framework.mention_edges(steps, pages, framework.words_of(files)).collect()}
    assert got == {("s_a.java", "p1"), ("s_b.ts", "p2"), ("s_c.py", "p1"), ("s_c.py", "p2")}


@pytest.mark.parametrize("small", [-1, 100_000])
def test_incremental_pairs_are_those_with_a_dirty_end(spark, monkeypatch, small):
    w = _weights(spark, [("b1", "flood deductible waiver"), ("b2", "renewal notice letter"), ("d1", "flood deductible waiver"), ("d2", "flood waiver renewal"), ("d3", "notice letter renewal")]).cache()
    a, b = w.where("id LIKE 'b%'"), w.where("id LIKE 'd%'")
    monkeypatch.setattr(similarity, "SMALL", small)
    every = {(r.source_id, r.target_id): r.score for r in similarity.cosine_pairs(a, b, 0.01).collect()}
    got = similarity.incremental_pairs(a, b, spark.createDataFrame([("b1",), ("d3",)], "id string"), 0.01).collect()
    want = {k: v for k, v in every.items() if k[0] == "b1" or k[1] == "d3"}
    assert len(got) == len(want) < len(every) and {(r.source_id, r.target_id): r.score for r in got} == pytest.approx(want)
