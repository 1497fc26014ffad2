"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.plans.schema import DOMAIN_STOPWORDS, GENERIC_STOPWORDS, ID_PREFIX

PUNCTUATION = r"""[!-/:-@\[-`{-~]"""


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(text: str | Column, extra_stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct discriminating terms: lower case, three characters or more, without stop words."""
    stop = F.array(*map(F.lit, (*GENERIC_STOPWORDS, *DOMAIN_STOPWORDS, *extra_stopwords)))
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z][a-z0-9_]{2,}"), 0)
    return F.array_except(F.array_distinct(found), stop)


def search_tokens(text: str | Column) -> Column:
    """Lower-case tokens between white space with ASCII punctuation deleted; repeats stay."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def raw_words(text: str | Column) -> Column:
    """Distinct lower-case words of three or more letters that stand alone."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"\b[a-zA-Z]{3,}\b"), 0), F.lower))


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def concept_slug(text: str | Column) -> Column:
    low = F.trim(F.lower(F.coalesce(_col(text), F.lit(""))))
    bare = F.regexp_replace(low, r"^(rule|feature|scenario outline|scenario)[:\s]+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def node_id(kind: str | Column, name: str | Column) -> Column:
    kind = _col(kind)
    prefixes = F.create_map(*(F.lit(x) for pair in ID_PREFIX.items() for x in pair))
    return F.concat(F.coalesce(F.element_at(prefixes, kind), kind), F.lit("_"), concept_slug(name))


def normal_path(path: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(path), F.lit("/"))), "[^a-z0-9]", "")


def checksum(content: str | Column) -> Column:
    return F.sha2(_col(content), 256)


def value_type(raw: str | Column) -> Column:
    """boolean, integer, float, list or string."""
    v = F.trim(_col(raw))
    quoted = v.startswith('"') | v.startswith("'")
    return (
        F.when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(r"^[+-]?\d+$"), "integer").when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").when(v.contains(",") & ~quoted, "list").otherwise("string")
    )


def header_name(header: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(header))), "[^a-z0-9_]", "_")


def heading_level(style: str | Column) -> Column:
    """The number in a style such as 'Heading 2', or null."""
    return F.nullif(F.regexp_extract(_col(style), r"(?i)heading\s*(\d+)", 1), F.lit("")).cast("int")


def is_pagination(text: str | Column) -> Column:
    return F.trim(_col(text)).rlike(r"(?i)^(page\s+)?\d+(\s*(of|/)\s*\d+)?$")


def substitute(text: str | Column, values: Column) -> Column:
    """Each <name> replaced by the map's value."""
    return F.aggregate(F.map_entries(values), _col(text), lambda acc, e: F.replace(acc, F.concat(F.lit("<"), e["key"], F.lit(">")), F.coalesce(e["value"], F.lit(""))))


def strip_comments(source: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(source), r"(?s)/\*.*?\*/", ""), r"(?m)//[^\n]*$", "")


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c.cast("string"), F.lit(""))), " | "), F.lit(" |"))


def byte_size(n: str | Column) -> Column:
    n = _col(n).cast("double")
    unit = lambda power: F.format_string("%.1f", F.bround(n / 1024**power, 1))
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(unit(1), F.lit(" KB"))).when(n < 1024**3, F.concat(unit(2), F.lit(" MB"))).otherwise(F.concat(unit(3), F.lit(" GB")))


def shard_name(text: str | Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(_col(text), "[^a-zA-Z0-9_-]", "_"), 1, 48), F.lit("")), F.lit("root"))


def truncated(text: str | Column, limit: int, keep: int | None = None, mark: str = "...") -> Column:
    """Texts longer than limit cut to `keep` (or limit) characters and marked."""
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, keep or limit), F.lit(mark))).otherwise(t)


def area_path(product: str | Column, feature: str | Column) -> Column:
    return F.concat_ws("\\", F.nullif(_col(product), F.lit("")), _col(feature))


def full_route(base: str | Column, route: str | Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("/"), F.coalesce(_col(base), F.lit("")), F.lit("/"), F.coalesce(_col(route), F.lit(""))), "/{2,}", "/")


def stamp(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss'z'")


def is_stale(started: str | Column, now: Column, hours: int = 24) -> Column:
    return _col(started) < now - F.expr(f"INTERVAL {hours} HOURS")


def relative_path(path: str | Column) -> Column:
    """Slashes forward, and what stands before `ingest/` removed."""
    return F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), r"^.*?(ingest/)", "$1")


def missing_limit(text: str | Column) -> Column:
    """Whether a text speaks of a limit without giving a number."""
    t = F.lower(_col(text))
    return t.rlike("limit|threshold|exceed|above|below") & ~t.rlike(r"\b\d+\b")


TEST_TYPES = {"happy_path": "HP", "functional_expansion": "FUNC", "boundary_limit": "BVA", "negative_security": "NEG"}


def test_type(category: str | Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in TEST_TYPES.items() for x in pair))
    found = F.element_at(kinds, _col(category))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), _col(category))))
