"""The registered queries of this package and their SQL: opN_<name>(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import alignment, chat, decontaminate, html_text, jaccard, licenses, line_dedup, mixing, quality, runs, sharding, token_counts, urls
from loomgraph.llm.common import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, under the operator's own limits."""
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own or inherited licence of every document.

    The table has no paths, so documents stand as files in a folder of their
    source, language and thousand of ids; every tenth is called LICENSE-<id>.
    """
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000").cast("string"), name)
    return licenses.scan(table(spark, sf_dir, "documents"), id_col="doc_id", path=path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of row counts at most one apart."""
    placed = sharding.place(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The conversation that op4 adds to the table: a text full of control strings.
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted string."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    records = chat.canonical(rows.unionByName(extra), F.to_variant_object(F.struct("role", "text"))).select("conv_id", "turn", F.posexplode("turns"))
    turns = records.select("conv_id", "turn", "pos", "col.role", "col.text")
    out = chat.format_turns(turns, order=("turn", "pos"))
    back, masked = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    whole = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size(back).cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(masked).cast("bigint").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths, with its sums for every limit."""
    return token_counts.histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The rules of op8 (fixed values of its contract).
URL_RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that stay: one edit from 5 code points on, two from 10 on."""
    return line_dedup.dedup(table(spark, sf_dir, "documents"), max_edits=2, min_chars=5).drop("body")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontaminate.containment_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def made_periodic(documents: DataFrame) -> DataFrame:
    """doc_id and text of the documents, of which op12 has every tenth, by crc32 of the id, repeat words a to a + p - 1 from word a on (fixed by its contract)."""
    h = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    # The words are bound once, as the one element of an array.
    repeated = r"""transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w ->
      transform(array(named_struct('a', (h div 10) % size(w), 'p', 1 + (size(w) - (h div 10) % size(w)) div (3 + (h div 10) % 8))), c ->
        array_join(transform(sequence(0, size(w) - 1), i -> w[CAST(IF(i < c.a, i, c.a + (i - c.a) % c.p) AS INT)]), ' '))[0])[0]"""
    return h.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), F.expr(repeated)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the one with most periods, and digests of all runs and of what stays without their repeats."""
    found = runs.periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    # Runs come by start and period, so that the first of equals stays.
    best = F.expr("aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    text = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    out = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens of every document."""
    return alignment.align(table(spark, sf_dir, "documents"))


def sharding_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 promises: rows, least, greatest and number of slots of every shard, and the bytes of all of them."""
    placed = op3_sharding(spark, sf_dir)
    slots = placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"), F.sum("size").alias("bytes"))
    return slots.select("shard", "n_rows", "first_slot", "last_slot", "n_slots", F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))  # 24 rows


#: Limits under which boilerplate decides about documents of small tables too, see quality_tight_limits().
TIGHT = {"few_percent": 4.0, "depleted_percent": 10}


def quality_tight_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1's operator says under limits that reject many documents for their common lines."""
    scored = quality.score(table(spark, sf_dir, "documents"), **TIGHT)
    return scored.select("doc_id", "n_words", "base_failed", "kept", "removed_words")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 works to: size, source size and target of every document."""
    mixed = op7_source_mixing(spark, sf_dir)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scans, op3_sharding, op4_chat_formatting, op5_token_counts, op6_ngram_jaccard_join, op7_source_mixing, op8_url_filters, op9_line_dedup, op10_benchmark_decontamination, op11_html_extraction, op12_periodic_runs, op13_token_alignment, sharding_laws, mixing_targets, quality_tight_limits
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_T = chat.Template()


def _escaped(column: str) -> str:
    """The template's escaping in SQL."""
    out = f"replace({column}, '{chat.ESCAPE}', '{chat.ESCAPE}0')"
    for string, code in _T.controls:
        out = f"replace({out}, '{string}', '{code}')"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Letters beyond ASCII and single bytes that stand for them, since DuckDB's edit distance counts bytes.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)])
_TERMS = f"list_filter(regexp_extract_all({{}}, '{licenses.TERM}'), lambda x: NOT list_contains([{', '.join(map(_quoted, licenses.STOP))}], x))"

def _quality_sql(few_percent: float, depleted_percent: int) -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep CROSS JOIN (VALUES (0), (1), (2)) AS t(j) GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, l, {_WORDS.format("l")} AS w FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)),
lw AS (SELECT doc_id, source, text, l, len(w) AS k, array_to_string(list_transform(w, lambda x: {_LOWER.format("x")}), ' ') AS norm FROM ln WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lw GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source),
held AS (SELECT source, norm, count(DISTINCT text) AS n FROM lw GROUP BY source, norm),
boiler AS (SELECT held.source, norm FROM held JOIN host ON held.source IS NOT DISTINCT FROM host.source 
  WHERE n > 50 AND n * 100 > host_docs * 2.0 OR n > 5 AND n * 100 > host_docs * {few_percent} OR n > 10000),
gone AS (SELECT doc_id, sum(k) AS removed_words FROM lw JOIN boiler ON lw.norm = boiler.norm AND lw.source IS NOT DISTINCT FROM boiler.source GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) 
  AND NOT 100 * removed_words > {depleted_percent} * n_words AND NOT (removed_words > 0 AND n_words - removed_words < 50) AS kept, removed_words FROM s
"""


SQL = {
    "op1_quality_rules": _quality_sql(5.0, 50),
    "quality_tight_limits": f"SELECT doc_id, n_words, base_failed, kept, removed_words FROM ({_quality_sql(**TIGHT)})",
    "op2_license_scans": rf"""
WITH template(i, name, body) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))}),
tt AS (SELECT i, name, unnest({_TERMS.format("lower(body)")}) AS t FROM template),
idf AS (SELECT t, ln(((SELECT count(*) FROM template) + 1) / (count(DISTINCT i) + 1)) + 1 AS idf FROM tt GROUP BY t),
tw AS (SELECT i, name, t, count(*) * any_value(idf) AS w FROM tt JOIN idf USING (t) GROUP BY i, name, t),
tn AS (SELECT i, sqrt(sum(w * w)) AS norm FROM tw GROUP BY i),
f AS (SELECT doc_id, lower(text) AS text, doc_id % 10 = 0 AS whole, concat_ws('/', source, lang, doc_id // 1000) AS dir, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' ELSE 'doc-' END || doc_id AS base FROM documents),
u AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM f UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) FROM f UNION ALL SELECT doc_id, text FROM f WHERE whole)),
ut AS (SELECT doc_id, unit, t, count(*) AS n FROM (SELECT doc_id, unit, unnest({_TERMS.format("unit")}) AS t FROM u) GROUP BY 1, 2, 3),
uw AS (SELECT doc_id, unit, ut.t, n * coalesce(idf, ln((SELECT count(*) FROM template) + 1) + 1) AS w FROM ut LEFT JOIN idf ON ut.t = idf.t),
un AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY 1, 2),
dots AS (SELECT doc_id, unit, i, name, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (t) GROUP BY 1, 2, 3, 4),
hit AS (SELECT doc_id, round(dot / (un.norm * tn.norm), 9) AS similarity, name AS own FROM dots JOIN un USING (doc_id, unit) JOIN tn USING (i)),
own AS (SELECT doc_id, similarity, own FROM hit WHERE similarity >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, own DESC) = 1),
j AS (SELECT f.doc_id, dir, whole, dir || '/' || base AS path, similarity, own FROM f LEFT JOIN own USING (doc_id)),
holder AS (SELECT dir AS h_dir, own AS h_own FROM j WHERE whole AND own IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, own DESC) = 1),
near AS (SELECT dir, h_dir, h_own FROM (SELECT DISTINCT dir FROM j) JOIN holder ON h_dir = '' OR dir = h_dir OR starts_with(dir, h_dir || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(h_dir) DESC) = 1)
SELECT doc_id, path, own, similarity, coalesce(own, h_own) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN h_own IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own IS NOT NULL THEN j.dir ELSE h_dir END AS origin_dir FROM j LEFT JOIN near ON j.dir = near.dir
""",
    "sharding_laws": """
WITH t AS (SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 8)::BIGINT AS all_bytes FROM documents),
s AS (SELECT unnest(range(24))::INT AS shard), r AS (SELECT shard, n // 24 + CASE WHEN shard < n % 24 THEN 1 ELSE 0 END AS n_rows, all_bytes FROM s, t)
SELECT shard, n_rows, 0::BIGINT AS first_slot, n_rows - 1 AS last_slot, n_rows AS n_slots, all_bytes FROM r WHERE n_rows > 0
""",
    "mixing_targets": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
-- A level is right when the sources that it does not fill to three times their size take up what the others leave.
lv AS (SELECT a.source AS s, ((SELECT sum(source_size) FROM z) - coalesce(sum(3 * b.source_size) FILTER (WHERE 3 * b.source_size / b.w < 3 * a.source_size / a.w), 0)) / sum(b.w) FILTER (WHERE 3 * b.source_size / b.w >= 3 * a.source_size / a.w) AS level, any_value(3 * a.source_size / a.w) AS ratio FROM z a, z b GROUP BY a.source),
x AS (SELECT max(level) FILTER (WHERE level <= ratio) AS level FROM lv)
SELECT doc_id, size, source_size, round(least(3.0 * source_size, coalesce(level * w, 3.0 * source_size))::DOUBLE, 6) AS target FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source, x
""",
    "op9_line_dedup": rf"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text <> ''),
w AS (SELECT doc_id, l, no::INT AS no FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
d AS (SELECT l, translate(l, '{_LETTERS}', {_BYTES}) AS t, length(l) AS n, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, n := no))) AS ord, min(struct_pack(d := doc_id, n := no)) AS place FROM w GROUP BY l),
k AS (SELECT ord, t, n, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM d WHERE n >= 5),
gone AS (SELECT DISTINCT k.ord FROM k JOIN d ON d.n = k.m AND d.n >= 5 AND d.ord < k.ord AND abs(d.n - k.n) * 5 <= least(d.n, k.n) WHERE levenshtein(k.t, d.t) <= 2 AND levenshtein(k.t, d.t) * 5 <= least(d.n, k.n)),
stay AS (SELECT place.d AS doc_id, list(place.n ORDER BY place.n) AS kept_lines FROM d WHERE ord NOT IN (SELECT ord FROM gone) GROUP BY place.d),
c AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(len(kept_lines), 0)::BIGINT AS n_kept, coalesce(kept_lines, []) AS kept_lines FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN stay USING (doc_id)
""",
    "op4_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_CONVERSATION}, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT {EXTRA_CONVERSATION}, 1, 'assistant', '{EXTRA_TEXT}'),
e AS (SELECT *, {_escaped("role")} AS er, {_escaped("text")} AS et FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + {sum(map(len, (_T.start, _T.middle, _T.end)))})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g, len(w) < 4 AS short FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS v FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.v = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.v) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op8_url_filters": rf"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, {_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}),
fit AS (SELECT page_id, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC, length(r_path) DESC) AS n
  FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT u.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND n = 1
""",
    # What the operator finds by cuts, the tables' pages mark: each has one article element, with p, h1, b and br in it.
    "op11_html_extraction": r"""
WITH m AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g') AS inner_html FROM pages),
d AS (SELECT page_id, url, unnest(string_split_regex(inner_html, '</?(p|h1|br)>')) AS raw, generate_subscripts(string_split_regex(inner_html, '</?(p|h1|br)>'), 1) AS no FROM m),
t AS (SELECT page_id, url, no, trim(regexp_replace(regexp_replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM d),
x AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY no) FILTER (WHERE block <> ''), '') AS text FROM t GROUP BY page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM x
""",
    "op10_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g, len(w) < 5 AS short FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS g, len(w) < 5 AS short FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (g, short) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles::BIGINT AS item_shingles, shared::BIGINT AS shared, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 100 * shared >= 80 * item_shingles
""",
}
