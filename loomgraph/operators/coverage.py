"""Test coverage of rules and features, test expansion and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import area_path, test_type


def features_with_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, area_path, rule_count, tests_edge_count): nodes carry parent_feature_id and parent_product_name."""
    rules = nodes.where("parent_feature_id is not null").select(F.col("id").alias("rule_id"), "parent_feature_id")
    tests = edges.where("relationship = 'TESTS'").groupBy(F.col("target_id").alias("rule_id")).agg(F.count("*").alias("tests"))
    per = rules.join(tests, "rule_id", "left").groupBy("parent_feature_id").agg(F.count("*").alias("rule_count"), F.coalesce(F.sum("tests"), F.lit(0)).alias("tests_edge_count"))
    features = nodes.where("type = 'product_feature'").select("id", area_path("parent_product_name", "name").alias("area_path"))
    joined = features.join(per, F.col("id") == F.col("parent_feature_id"), "left")
    return joined.select("id", "area_path", F.coalesce("rule_count", F.lit(0)).alias("rule_count"), F.coalesce("tests_edge_count", F.lit(0)).alias("tests_edge_count"))


def incoming_counts(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("TESTS", "IMPLEMENTS", "VALIDATES")) -> DataFrame:
    """(id, a count for each relationship): the edges into each node."""
    counts = edges.where(F.col("relationship").isin(*kinds)).groupBy(F.col("target_id").alias("t")).agg(*(F.count_if(F.col("relationship") == k).alias(k.lower()) for k in kinds))
    return nodes.select("id").join(counts, F.col("id") == F.col("t"), "left").select("id", *(F.coalesce(k.lower(), F.lit(0)).alias(k.lower()) for k in kinds))


def traceability(rules: DataFrame, edges: DataFrame, nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """(rule_id, scenarios, technical, titles): names of the neighbours of each rule, either way, or None Linked."""
    ends = edges.select(F.col("source_id").alias("r"), F.col("target_id").alias("o")).unionAll(edges.select("target_id", "source_id")).distinct()
    near = ends.join(rules.select(F.col("id").alias("r")), "r").join(nodes.select(F.col("id").alias("o"), "type", "name"), "o")
    names = lambda *kinds: F.array_join(F.array_sort(F.collect_set(F.when(F.col("type").isin(*kinds), F.col("name")))), ", ")
    linked = near.groupBy("r").agg(names("test_scenario").alias("scenarios"), names("api_endpoint", "data_model").alias("technical"))
    titles = tests.groupBy(F.col("target_rule_id").alias("tr")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    or_none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("None Linked"))
    out = rules.select(F.col("id").alias("rule_id")).join(linked, F.col("rule_id") == F.col("r"), "left").join(titles, F.col("rule_id") == F.col("tr"), "left")
    return out.select("rule_id", or_none("scenarios").alias("scenarios"), or_none("technical").alias("technical"), F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


def untested(rules: DataFrame, tests: DataFrame) -> DataFrame:
    return rules.join(tests.select(F.col("target_rule_id").alias("id")), "id", "left_anti")


def metrics(rules: DataFrame, categories: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: rule and condition coverage in per cent (one decimal), tests, steps, steps per test."""
    targets = rules.select(F.col("id")).distinct()
    covered = targets.join(tests.select(F.col("target_rule_id").alias("id")), "id", "left_semi").agg(F.count("*").alias("covered"))
    wanted = rules.agg(F.count("*").alias("wanted"))
    volume = tests.agg(F.count("*").alias("total_tests"), F.coalesce(F.sum("n_steps"), F.lit(0)).alias("total_steps"))
    made = tests.groupBy("category_id").agg(F.count("*").alias("made"))
    total = F.when(F.coalesce("total_conditions_count", F.lit(0)) == 0, 1).otherwise(F.col("total_conditions_count"))
    conditions = categories.withColumn("total", total).join(made, "category_id", "left").agg(F.sum(F.least(F.coalesce("made", F.lit(0)), F.col("total"))).alias("met"), F.sum("total").alias("conditions"))
    row = covered.crossJoin(wanted).crossJoin(volume).crossJoin(conditions)  # single rows
    share = lambda a, b, d: F.coalesce(F.round(F.try_divide(F.col(a) * (100.0 if d == 1 else 1.0), F.col(b)), d), F.lit(0.0))
    return row.select(share("covered", "wanted", 1).alias("rule_coverage"), share("met", "conditions", 1).alias("condition_coverage"), "total_tests", "total_steps", share("total_steps", "total_tests", 2).alias("steps_per_test"))


def linear_expansion(classes: DataFrame) -> DataFrame:
    """Rows (rule_id, test_number, varied, values) from (rule_id, attribute, ord, value, is_baseline).

    Row 1 is the baseline; then each other class of each attribute replaces the baseline's value once.
    """
    base = classes.where("is_baseline").groupBy("rule_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("base"))
    one = base.select("rule_id", F.lit(1).cast("bigint").alias("test_number"), F.lit(None).cast("string").alias("varied"), F.col("base").alias("values"))
    other = classes.where("not is_baseline").withColumn("test_number", 1 + F.row_number().over(Window.partitionBy("rule_id").orderBy("attribute", "ord"))).join(base, "rule_id")
    changed = F.transform_values("base", lambda k, v: F.when(k == F.col("attribute"), F.col("value")).otherwise(v))
    return one.unionByName(other.select("rule_id", F.col("test_number").cast("bigint").alias("test_number"), F.col("attribute").alias("varied"), changed.alias("values")))


def distinct_rows(matrix: DataFrame) -> DataFrame:
    """The first row of each equal set of values in a rule."""
    same = Window.partitionBy("rule_id", F.array_sort(F.map_entries("values"))).orderBy("test_number")
    return matrix.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def matrix_violations(matrix: DataFrame) -> DataFrame:
    """(rule_id, baselines, baseline_first, titles_unique) of matrices with columns test_number, varied and title."""
    return matrix.groupBy("rule_id").agg(
        F.count_if(F.col("varied").isNull()).alias("baselines"), F.min(F.when(F.col("varied").isNull(), F.col("test_number"))).eqNullSafe(F.lit(1)).alias("baseline_first"), (F.count("title") == F.count_distinct("title")).alias("titles_unique")
    )


@F.pandas_udf(T.StringType())
def feature_slug(names):
    """Initials, then the words' further letters in turn, up to twelve; at least three, filled with X."""
    import re

    def slug(name: str | None) -> str:
        parts = re.sub(r"[^A-Za-z0-9 ]", "", name or "").split()
        if not parts:
            return "FEATURE"
        longest = max(map(len, parts))
        letters = [w[i] for i in range(longest) for w in parts if i < len(w)]
        return "".join(letters[: max(12, 0)]).upper()[:12].ljust(3, "X")

    return names.map(slug, na_action=None)


def test_ids(tests: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Tests (slug, category_id, ord, ..) with tc_id; numbering goes on from counters (slug, kind, last)."""
    kinds = tests.withColumn("kind", test_type("category_id"))
    n = F.row_number().over(Window.partitionBy("slug", "kind").orderBy("ord"))
    if counters is not None:
        kinds = kinds.join(counters, ["slug", "kind"], "left")
        n = n + F.coalesce("last", F.lit(0))
    kinds = kinds.withColumn("seq", n)
    number = F.when(F.col("seq") > 999, F.col("seq").cast("string")).otherwise(F.lpad(F.col("seq").cast("string"), 3, "0"))
    return kinds.withColumn("tc_id", F.concat_ws("_", F.lit("TC"), "slug", "kind", number)).drop("seq", "last")


def asserts_in_first_step(steps: Column) -> Column:
    """Whether step 1 already asserts something."""
    return F.exists(steps, lambda s: (s["step_number"] == 1) & F.lower(s["action"]).rlike(r"\b(verify|assert|confirm|validate|check that|ensure)\b"))


def with_setup_step(steps: Column, action: str = "Open the application") -> Column:
    """The steps with a set-up step before them and numbers moved on."""
    moved = F.transform(steps, lambda s: F.struct((s["step_number"] + 1).alias("step_number"), s["action"].alias("action"), s["expected"].alias("expected")))
    return F.concat(F.array(F.struct(F.lit(1).alias("step_number"), F.lit(action).alias("action"), F.lit("").alias("expected"))), moved)


def audit(matrix: DataFrame, tests: DataFrame, rules: DataFrame) -> DataFrame:
    """(point, subject): matrix rows without a test of the title, tests of unknown rules, tests with fewer than two steps, bad ids."""
    missing = matrix.join(tests.select("title"), "title", "left_anti").select(F.lit("row without test").alias("point"), F.col("title").alias("subject"))
    unknown = tests.join(rules.select(F.col("id").alias("target_rule_id")), "target_rule_id", "left_anti").select(F.lit("unknown rule").alias("point"), F.col("tc_id").alias("subject"))
    short = tests.where("n_steps < 2").select(F.lit("too few steps").alias("point"), F.col("tc_id").alias("subject"))
    odd = tests.where(~F.col("tc_id").rlike(r"^TC_[A-Z0-9]+_(HP|FUNC|BVA|NEG)_\d{3,}$")).select(F.lit("bad id").alias("point"), F.col("tc_id").alias("subject"))
    return missing.unionByName(unknown).unionByName(short).unionByName(odd)


# What a first step must not say, columns that are no fields of a page.
ASSERTIONS = ("assert", "verify", "status code", "responds with", "returns", "validates", "should return", "expect")
META_COLUMNS = ("flow_type", "test_id", "tc_id", "expected_result", "expected", "reference", "iteration", "test_data_set", "data_set_name")
BOUNDARIES = ("boundary_low", "boundary_at", "boundary_high")
# End of the fixed values.


def audit_steps(steps: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """(point, severity, tc_id, step_number, action_type) of steps (tc_id, step_number, action, expected) that break a rule.

    2: step 1 asserts something.  3: a step expects what the step before it did.
    6: a step lacks a number, action or expected outcome, or names two status
    codes.  7: a step fills in a column of the test data.  9: a test of a matrix
    row (tc_id, precondition; null: none is needed) has no such text in its first
    two steps, in any case of letters.
    """
    both = F.lower(F.concat_ws(" ", "action", "expected"))
    said = F.lit(False)
    for word in ASSERTIONS:
        said = said | F.contains(both, F.lit(word))

    def found(rows: DataFrame, point: int, severity: str, remedy: str) -> DataFrame:
        return rows.select(F.lit(point).alias("point"), F.lit(severity).alias("severity"), "tc_id", "step_number", F.lit(remedy).alias("action_type"))

    before = steps.where("expected != ''").select(F.col("tc_id").alias("b_id"), (F.col("step_number") + 1).alias("b_number"), F.col("expected").alias("b_expected"))
    same = (F.col("tc_id") == F.col("b_id")) & (F.col("step_number") == F.col("b_number")) & (F.col("expected") == F.col("b_expected"))
    columns = "|".join(META_COLUMNS)
    out = found(steps.where((F.col("step_number") == 1) & said), 2, "high", "FIX_EXPECTED_OUTCOME")
    out = out.unionByName(found(steps.join(before, same, "left_semi"), 3, "medium", "FIX_EXPECTED_OUTCOME"))
    empty = F.col("step_number").isNull() | (F.coalesce("action", F.lit("")) == "") | (F.coalesce("expected", F.lit("")) == "")
    out = out.unionByName(found(steps.where(empty | F.coalesce(F.col("expected").rlike(r"\b\d{3} or \d{3}\b"), F.lit(False))), 6, "low", "FIX_STATUS_CODE"))
    out = out.unionByName(found(steps.where(F.lower("action").rlike(rf"\b(enter ({columns}) value|select ({columns}) option)\b")), 7, "high", "REMOVE_META_COLUMN_FROM_UI"))
    if matrix is not None:
        needed = matrix.where("precondition is not null").select("tc_id", F.lower("precondition").alias("p"))
        met = steps.where("step_number <= 2").join(needed, "tc_id").where(F.contains(both, F.col("p"))).select("tc_id")
        out = out.unionByName(found(needed.join(met, "tc_id", "left_anti").withColumn("step_number", F.lit(None).cast(steps.schema["step_number"].dataType)), 9, "medium", "ADD_STATEFUL_PRECONDITION"))
    return out


def row_categories(rows: DataFrame) -> DataFrame:
    """(category_id, candidate_count) of matrix rows (is_straight_through, varied_attribute, partition): only categories that have rows; all straight rows are one candidate."""
    rbac = F.coalesce(F.col("varied_attribute") == "RBAC", F.lit(False))
    category = F.when(F.col("is_straight_through"), "happy_path").when(rbac, "negative_security").when(F.col("partition").isin(*BOUNDARIES), "boundary_limit").otherwise("functional_expansion")
    counted = rows.groupBy(category.alias("category_id")).agg(F.count("*").alias("n"))
    return counted.select("category_id", F.when(F.col("category_id") == "happy_path", F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("candidate_count"))


def loop_state(iterations: DataFrame, ceiling: int = 3) -> DataFrame:
    """(iteration, gaps, state): success without gaps, divergence if they did not fall, ceiling, else continue."""
    before = F.lag("gaps").over(Window.orderBy("iteration"))
    state = F.when(F.col("gaps") == 0, "success").when(F.col("gaps") >= before, "divergence").when(F.col("iteration") >= ceiling, "ceiling").otherwise("continue")
    return iterations.withColumn("state", state)


def csv_rows(tests: DataFrame, area: str) -> DataFrame:
    """The nine columns of a work-item import: a row for each step, each with the test's data; a test without steps has one row."""
    steps = tests.select("title", F.posexplode_outer("steps").alias("pos", "s"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.when(F.col("pos").isNotNull(), F.coalesce(F.col("s.step_number"), F.col("pos") + 1))
    return steps.select(
        F.lit("").alias("ID"), F.lit("Test Case").alias("Work Item Type"), F.col("title").alias("Title"), F.coalesce(number.cast("string"), F.lit("")).alias("Test Step"),
        text("s.action").alias("Step Action"), text("s.expected").alias("Step Expected"), F.lit(area).alias("Area Path"), F.lit("").alias("Assigned To"), F.lit("Design").alias("State"),
    )


METHODOLOGIES = {
    # rule type: (always, only with a numeric or date limit, only with a status)
    "binary_flag": (("EP", "Linear Expansion", "RBAC"), (), ()),
    "numeric_threshold": (("EP", "BVA", "Linear Expansion", "RBAC"), (), ()),
    "lifecycle": (("EP", "State Transition", "Linear Expansion", "RBAC"), ("BVA",), ()),
    "multi_attribute": (("EP", "Linear Expansion", "RBAC"), ("BVA",), ("State Transition",)),
    "role_access": (("EP", "Linear Expansion", "RBAC"), (), ()),
}


def default_rule_type(kind: str = "type", text: str = "description") -> Column:
    """The rule type that a node's type suggests, or null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    k = F.col(kind)
    return (
        F.when(k == "validation_rule", F.when(t.rlike(r"\b(min|max|minimum|maximum|at least|at most)\b|[<>]=?|\b\d+\b"), "numeric_threshold").otherwise("binary_flag")).when(k == "eligibility_rule", "numeric_threshold")
        .when(k == "ui_business_rule", "binary_flag").when(k == "security_rule", F.when(t.rlike("attempt|cooldown|expir"), "lifecycle").otherwise("role_access"))
    )


def methodologies(rules: DataFrame) -> DataFrame:
    """Rules (rule_type, has_limit, has_status) with the methodologies that apply."""
    out = F.array().cast("array<string>")
    for kind, (always, with_limit, with_status) in METHODOLOGIES.items():
        names = F.array(*(F.lit(n) for n in always), *(F.when(F.col("has_limit"), n) for n in with_limit), *(F.when(F.col("has_status"), n) for n in with_status))
        out = F.when(F.col("rule_type") == kind, F.array_compact(names)).otherwise(out)
    return rules.withColumn("methodologies", out)


def analysis_violations(analysis: DataFrame, classes: DataFrame) -> DataFrame:
    """(rule_id, violation): methods both applied and skipped, classes of unknown attributes, attributes without exactly one straight-through class."""
    both = analysis.where(F.arrays_overlap("applicable", "skipped")).select("rule_id", F.lit("methodology both applied and skipped").alias("violation"))
    known = analysis.select("rule_id", F.explode("attributes").alias("attribute"))
    unknown = classes.join(known, ["rule_id", "attribute"], "left_anti").select("rule_id", F.concat(F.lit("unknown attribute "), "attribute").alias("violation")).distinct()
    straight = classes.groupBy("rule_id", "attribute").agg(F.count_if("is_straight_through").alias("n"))
    odd = known.join(straight, ["rule_id", "attribute"], "left").where(F.coalesce("n", F.lit(0)) != 1).select("rule_id", F.concat(F.lit("not one straight-through class of "), "attribute").alias("violation"))
    return both.unionAll(unknown).unionAll(odd)


def gap_log_is_consistent(is_compliant: str = "is_compliant", gaps: str = "gaps") -> Column:
    """A compliant log has no gaps, another has some."""
    return F.col(is_compliant) == (F.size(F.coalesce(gaps, F.array())) == 0)


def in_scope(proposals: DataFrame, scope: DataFrame) -> DataFrame:
    """Proposals of the confirmed categories."""
    return proposals.join(scope.select("category_id"), "category_id", "left_semi")


def constraint_block(constraints: DataFrame) -> DataFrame:
    """One row: the given limits (rule_id, constraint) as lines of text; the constraints of one session."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), "rule_id", F.lit(": "), "constraint")))
    return constraints.agg(F.array_join(lines, "\n").alias("block"))


def loop_history(iterations: DataFrame) -> DataFrame:
    """(iterations, first_gaps, last_gaps, resolved) of a loop (iteration, gaps)."""
    return iterations.agg(F.count("*").alias("iterations"), F.min_by("gaps", "iteration").alias("first_gaps"), F.max_by("gaps", "iteration").alias("last_gaps")).withColumn("resolved", F.col("first_gaps") - F.col("last_gaps"))


def report_markdown(metrics: DataFrame, matrix: DataFrame, gaps: DataFrame) -> str:
    """The coverage report of one run as Markdown; its tables are of a size that people read."""
    m = metrics.head()
    table = lambda rows, names: "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)])
    parts = ["# Coverage", f"- Rules: {m.rule_coverage} %", f"- Conditions: {m.condition_coverage} %", f"- Tests: {m.total_tests}, steps: {m.total_steps}, {m.steps_per_test} each", "", "## Traceability"]
    parts += [table(matrix.orderBy("rule_id").toLocalIterator(), ["rule_id", "scenarios", "technical"]), "", "## Gaps", table(gaps.orderBy("id").toLocalIterator(), ["id"])]
    return "\n".join(parts) + "\n"
