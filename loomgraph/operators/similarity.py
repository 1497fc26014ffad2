"""Similarity joins: edges inferred from shared terms.

Never a cross join: documents meet in an inverted index on terms, and the
cosine over sets needs only the squared IDF of shared terms and the norms.
Frequent terms weigh least and cost most; prefixes leave most of them out, and
the rest is left to adaptive execution's splitting of skewed join keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.shared import materialise
from loomgraph.functions.text import raw_words, smoothed_idf, terms
from loomgraph.plans.schema import AUTO_EMIT, CANDIDATE

#: Terms whose IDF is broadcast; ids and rows of prefixes that may be; sources and targets of a cell.
COMMON, FEW, SMALL, SIDE = 50_000, 500_000, 100_000, 32


def term_table(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", extra_stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(id, term), once each."""
    return docs.select(F.col(id_col).alias("id"), F.explode(terms(text_col, extra_stopwords)).alias("term"))


def idf_table(postings: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) over a corpus of n_docs documents."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", smoothed_idf(F.lit(n_docs), F.col("df")))


def _with_idf(postings: DataFrame, idf: DataFrame, how: str = "inner") -> DataFrame:
    """Postings with the IDF of their terms.  A bounded number of the commonest terms is broadcast: they are most postings, and only those of rarer terms are shuffled."""
    idf = idf.select("term", "idf")
    looked = postings.join(F.broadcast(idf.orderBy("idf", "term").limit(COMMON)), "term", "left")
    rare = looked.where("idf is null").drop("idf").join(idf, "term", how)
    return looked.where("idf is not null").unionByName(rare)


def _weighed(rows: DataFrame, floor: float) -> DataFrame:
    """Rows (id, term, idf, ..) with w, norm2 and rest: what a term and the lighter ones of its document weigh, 0 where that is below floor**2 of norm2."""
    heavier = Window.partitionBy("id").orderBy("w", F.col("term").desc())
    summed = rows.withColumn("w", F.col("idf") * F.col("idf")).withColumn("norm2", F.sum("w").over(heavier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("rest", F.sum("w").over(heavier.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.withColumn("rest", F.when(F.col("rest") >= F.col("norm2") * _share(floor), F.col("rest")).otherwise(0.0))


def _share(floor: float) -> float:
    return floor * floor * (1 - 1e-9)


def weights(postings: DataFrame, idf: DataFrame, floor: float = 0.0) -> DataFrame:
    """(id, term, w, idf, norm2, rest): squared weights, the sum of them for each document, and what each term and the lighter ones weigh, as far as pairs at or above the floor need it."""
    return _weighed(_with_idf(postings, idf), floor)


def _prefixes(weighted: DataFrame, floor: float, name: str) -> DataFrame:
    """(name, term, name_rest, name_norm): the heaviest terms of each document, down to where the rest cannot reach the floor any more, with what each and the lighter ones weigh."""
    # Weights that were stored without it may have any: none weighs more than all.
    rested = weighted.withColumn("rest", F.coalesce("rest", "norm2")) if "rest" in weighted.columns else _weighed(weighted, floor)
    return rested.where(F.col("rest") >= F.col("norm2") * _share(floor)).select(F.col("id").alias(name), "term", F.col("rest").alias(f"{name}_rest"), F.col("norm2").alias(f"{name}_norm"), "w")


def _vectors(weighted: DataFrame) -> DataFrame:
    """(id, terms, idfs, norm), one row a document: its terms, the heaviest first, in one string, and the IDF of each; both compress well."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("k"), "term")))
    rows = weighted.groupBy("id").agg(listed.alias("t"), F.max("norm2").alias("norm"))
    return rows.select("id", F.array_join(F.col("t")["term"], " ").alias("terms"), F.transform(F.col("t")["k"], lambda k: -k).alias("idfs"), "norm")


def _coded(vectors: str) -> Column:
    """A list of vectors with strings for terms that hold the IDF too and are equal where the terms are."""
    code = lambda v: F.zip_with(F.split(v["terms"], " "), v["idfs"], lambda t, k: F.concat_ws(" ", t, k.cast("string")))
    return F.transform(vectors, lambda v: F.struct(v["id"].alias("id"), code(v).alias("terms"), v["norm"].alias("norm")))


def _counted(rows: DataFrame, most: int) -> DataFrame:
    """Written rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _meeting(left: DataFrame, right: DataFrame, floor: float, *more: Column) -> DataFrame:
    """(source_id, target_id), once each: documents of two tables of prefixes that share a term at which both can reach the floor."""
    enough = F.least("source_id_rest", "target_id_rest") >= F.sqrt(F.col("source_id_norm") * F.col("target_id_norm")) * (floor * (1 - 1e-9))
    met = left.join(right, "term").where(enough)
    for condition in more:
        met = met.where(condition)
    return met.select("source_id", "target_id").distinct()


CELL = ("block", "i", "j")


def _cells(pairs: DataFrame) -> DataFrame:
    """Pairs with their cell (block, i, j): some SIDE sources and SIDE targets that meet often.

    A target's block is its least source, which alike targets have in common; blocks
    of many documents are cut on both sides.  Vectors go to cells, once for each.
    """
    placed = pairs.join(pairs.groupBy("target_id").agg(F.min("source_id").alias("block")), "target_id")
    count = lambda end: placed.select("block", end).distinct().groupBy("block").agg(F.count("*").alias(f"{end}s"))
    part = lambda end: F.pmod(F.xxhash64(end), F.ceil(F.col(f"{end}s") / SIDE))
    sized = placed.join(count("source_id"), "block").join(count("target_id"), "block")
    return sized.select("block", part("source_id").alias("i"), part("target_id").alias("j"), "source_id", "target_id")


def _in_cells(pairs: DataFrame, left: Callable[[DataFrame], DataFrame], right: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(pairs, xs, ys), one row a cell: its pairs and, once each, what left and right have for their sources and targets; without right, left has it for both.

    left and right take ids (id) and give one row for each: id and more.
    """
    cells = materialise(_cells(materialise(pairs)))

    def brought(side: Callable[[DataFrame], DataFrame], ends: tuple[str, ...], name: str) -> DataFrame:
        at = cells.select(*CELL, F.explode(F.array(*ends)).alias("id")).distinct()
        found = side(_counted(materialise(at.select("id").distinct()), FEW))
        return at.join(found, "id").groupBy(*CELL).agg(F.collect_list(F.struct(*found.columns)).alias(name))

    whole = cells.groupBy(*CELL).agg(F.collect_list(F.struct("source_id", "target_id")).alias("pairs"))
    if right is None:
        return whole.join(brought(left, ("source_id", "target_id"), "xs"), list(CELL)).withColumn("ys", F.col("xs"))
    return whole.join(brought(left, ("source_id",), "xs"), list(CELL)).join(brought(right, ("target_id",), "ys"), list(CELL))


def _in(side: str, id_: Column) -> Column:
    return F.get(side, (F.array_position(F.col(side)["id"], id_) - 1).cast("int"))


def _likely(pairs: DataFrame, heads: DataFrame, floor: float) -> DataFrame:
    """The pairs of one table that can reach the floor by what their prefixes share.

    Of two prefixes one ends first in the order of all terms, by weight and name.  What
    the pair shares outside of both comes later, and so is among the lighter terms of
    that one's document.  Codes hold a term's hash and its weight, rounded up; if
    two of a document's are equal, all of it counts as lighter terms.
    """
    code = F.shiftleft(F.xxhash64("term"), 16).bitwiseOR(F.ceil(F.col("w") * 100).cast("bigint"))
    rows = heads.withColumn("code", code).groupBy("id").agg(F.collect_list("code").alias("codes"), F.min(F.col("id_rest") - F.col("w")).alias("light"), F.max("id_norm").alias("norm"))
    rows = rows.withColumn("light", F.when(F.size(F.array_distinct("codes")) < F.size("codes"), F.col("norm")).otherwise(F.col("light")))
    weight = lambda c: c.bitwiseAND(F.lit(0xFFFF)) / 100

    def can(p: Column) -> Column:
        x, y = _in("xs", p["source_id"]), _in("ys", p["target_id"])
        shared = F.aggregate(F.array_intersect(x["codes"], y["codes"]), F.lit(0.0), lambda sum_, c: sum_ + weight(c))
        return shared + F.greatest(x["light"], y["light"]) >= F.sqrt(x["norm"] * y["norm"]) * (floor * (1 - 1e-9))

    return _in_cells(pairs, lambda ids: rows.join(ids, "id", "left_semi"), None).select(F.explode(F.filter("pairs", can)).alias("p")).select("p.*")


def _scores(pairs: DataFrame, left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(source_id, target_id, score, tokens) of the pairs (source_id, target_id) whose whole vectors reach the floor."""
    vectors = lambda weighted: lambda ids: _vectors(weighted.join(ids, "id", "left_semi"))
    whole = _in_cells(pairs, vectors(left), None if left is right else vectors(right))
    whole = whole.withColumns({side: _coded(side) for side in ("xs", "ys")})
    weight = lambda code: F.pow(F.substring_index(code, " ", -1).cast("double"), F.lit(2.0))

    def judged(p: Column) -> Column:
        x, y = _in("xs", p["source_id"]), _in("ys", p["target_id"])
        norm = F.sqrt(x["norm"] * y["norm"])
        # A list of one, so that the shared terms are found once for the score and the heaviest of them.
        said = lambda t: F.struct((F.aggregate(t, F.lit(0.0), lambda sum_, c: sum_ + weight(c)) / norm).alias("score"), F.slice(t, 1, 5).alias("top"))
        return F.struct(p["source_id"].alias("source_id"), p["target_id"].alias("target_id"), F.transform(F.array(F.array_intersect(x["terms"], y["terms"])), said)[0].alias("s"))

    found = whole.select(F.explode(F.filter(F.transform("pairs", judged), lambda r: r["s"]["score"] >= floor)).alias("r"))
    return found.select("r.source_id", "r.target_id", "r.s.score", F.transform("r.s.top", lambda c: F.substring_index(c, " ", 1)).alias("tokens"))


def cosine_pairs(left: DataFrame, right: DataFrame, floor: float = CANDIDATE) -> DataFrame:
    """(source_id, target_id, score, tokens): pairs of two weight tables at or above the floor, with the five heaviest shared terms.

    The tables hold weights of one corpus, under one IDF.  Let t be the heaviest
    term that two documents share.  All that they share is t and lighter, so by
    Cauchy and Schwarz the score is at most the root of the share of either's
    square norm that t and its lighter terms make up.  So both have t among
    their heaviest terms down to floor**2 of the norm, and documents that meet
    in no such term need not be looked at.  Frequent terms are light: they are
    seldom joined.  Nor can the pair share more than t and lighter terms weigh in
    either, so at t the lesser of both must reach the floor.  Whole vectors decide;
    they travel to cells of pairs, not with each pair.
    """
    own = materialise(_prefixes(left, floor, "source_id"))
    return _scores(_meeting(_counted(own, SMALL), _prefixes(right, floor, "target_id"), floor), left, right, floor)


def cosine_twins(weighted: DataFrame, floor: float) -> DataFrame:
    """The pairs of one table as cosine_pairs() gives them, each once, source_id < target_id, and none of a document with itself.

    Documents with the same terms are one class.  Classes meet, by their first
    documents; those that pass by their prefixes are compared whole, and only what is
    found comes back to all documents.
    """
    keyed = weighted.groupBy("id").agg(F.bit_xor(F.xxhash64("term")).alias("h1"), F.bit_xor(F.xxhash64("term", F.lit(1))).alias("h2"))
    first = keyed.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    members = materialise(keyed.join(first, ["h1", "h2"]).select("id", "first"))
    later = members.where("id != first")
    heads = materialise(_prefixes(weighted, floor, "id").join(_counted(later.select("id"), FEW), "id", "left_anti"))
    end = lambda name: heads.select(F.col("id").alias(name), "term", F.col("id_rest").alias(f"{name}_rest"), F.col("id_norm").alias(f"{name}_norm"))
    met = _meeting(end("source_id"), end("target_id"), floor, F.col("source_id") < F.col("target_id"))
    same = later.select(F.col("first").alias("source_id"), F.col("first").alias("target_id")).distinct()
    found = _scores(_likely(met, heads, floor).unionByName(same), weighted, weighted, floor)
    a, b = (members.select(F.col("first").alias(name), F.col("id").alias(x)) for name, x in (("source_id", "a"), ("target_id", "b")))
    all_ = found.join(a, "source_id").join(b, "target_id").where((F.col("source_id") != F.col("target_id")) | (F.col("a") < F.col("b")))
    return all_.select(F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"), "score", "tokens")


def split_by_threshold(pairs: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """Edges at or above max(min_score, AUTO_EMIT), and the candidates below it."""
    limit = max(min_score, AUTO_EMIT)
    return pairs.where(F.col("score") >= limit), pairs.where((F.col("score") >= CANDIDATE) & (F.col("score") < limit))


def new_pairs(pairs: DataFrame, edges: DataFrame, relationship: str) -> DataFrame:
    """The pairs that are not edges of this relationship yet."""
    have = edges.where(F.upper("relationship") == relationship).select("source_id", "target_id").distinct()
    return pairs.join(have, ["source_id", "target_id"], "left_anti")


def incremental_pairs(left: DataFrame, right: DataFrame, dirty: DataFrame, floor: float = CANDIDATE) -> DataFrame:
    """The cosine pairs of which at least one end is dirty: dirty x all and clean x dirty.

    If the prefixes of left are few, they are broadcast and meet all of right where it
    lies, and the pairs are sifted; else the documents are, before they meet.
    """
    d = dirty.select("id").distinct()
    own = materialise(_prefixes(left, floor, "source_id"))
    if own.count() <= SMALL:
        met = _meeting(F.broadcast(own), _prefixes(right, floor, "target_id"), floor)
        known = _counted(materialise(d), FEW)
        marked = lambda end: known.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_dirty"))
        sifted = met.join(marked("source_id"), "source_id", "left").join(marked("target_id"), "target_id", "left").where("source_id_dirty OR target_id_dirty")
        return _scores(sifted.select("source_id", "target_id"), left, right, floor)
    first = cosine_pairs(left.join(d, "id", "left_semi"), right, floor)
    rest = cosine_pairs(left.join(d, "id", "left_anti"), right.join(d, "id", "left_semi"), floor)
    return first.unionByName(rest)


def late_documents(docs: DataFrame, idf: DataFrame, n_docs: int, floor: float = 0.0, **columns) -> DataFrame:
    """Weights of documents that came later, under the IDF as it was; unknown terms have df 0."""
    postings = term_table(docs, **columns)
    unknown = smoothed_idf(F.lit(n_docs), F.lit(0))
    return _weighed(_with_idf(postings, idf, "left").withColumn("idf", F.coalesce("idf", unknown)), floor)


def shared_name_words(left: DataFrame, right: DataFrame, words: Column, keep: int = 5) -> DataFrame:
    """(source_id, target_id, tokens): pairs (id, name) with a common word outside `words` (an array), at most `keep` of them listed."""
    a = left.select(F.col("id").alias("source_id"), F.explode(F.array_except(raw_words("name"), words)).alias("w"))
    b = right.select(F.col("id").alias("target_id"), F.explode(F.array_except(raw_words("name"), words)).alias("w"))
    return a.join(b, "w").groupBy("source_id", "target_id").agg(F.slice(F.array_sort(F.collect_set("w")), 1, keep).alias("tokens"))


def overlapping(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(source_id, target_id, shared): pairs (id, text) with at least so many common raw words.

    Of `least` words that a pair shares, one at least is not among the right
    one's least - 1 most frequent; pairs meet in the others only, and whole lists
    of words then count.  A word that a third of all rows have is seldom joined.
    """
    tokens = lambda df, name: df.select(F.col("id").alias(name), F.array_sort(raw_words("text")).alias(f"{name}_words")).where(F.size(f"{name}_words") >= least)
    a, b = tokens(left, "source_id"), tokens(right, "target_id")
    # Rows with the same words are one list, with a number; lists meet, and rows come back to them by equality.
    lists = lambda df, c, n: materialise(df.select(c).distinct().withColumn(n, F.monotonically_increasing_id()))
    x, y = lists(a, "source_id_words", "x"), lists(b, "target_id_words", "y")
    posted = x.select("x", F.explode("source_id_words").alias("w"))
    counts = posted.groupBy("w").agg(F.count("*").alias("held"))
    listed = y.select("y", F.explode("target_id_words").alias("w")).join(counts, "w")
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("held"), "w"))
    pairs = posted.join(listed.withColumn("rank", rank).where(F.col("rank") >= least).select("y", "w"), "w").select("x", "y").distinct()
    both = pairs.join(x, "x").join(y, "y").withColumn("shared", F.size(F.array_intersect("source_id_words", "target_id_words")).cast("bigint")).where(F.col("shared") >= least)
    return a.join(both, "source_id_words").join(b, "target_id_words").select("source_id", "target_id", "shared")


def is_functional(rule_origin: str = "rule_origin") -> Column:
    return F.coalesce(rule_origin, F.lit("functional")) != "nfr"


def is_admin_route(path: str = "path") -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    return F.contains(p, F.lit("admin")) | F.contains(p, F.lit("reset"))


def top_candidates(candidates: DataFrame, limit: int = 50) -> DataFrame:
    return candidates.orderBy(F.desc("score"), "source_id", "target_id").limit(limit)


def within_budget(candidates: DataFrame, text: str, limit: int = 60_000) -> DataFrame:
    """The best candidates whose texts together stay within the limit, by score, then ids, with the characters `used` up to each.

    Totals of equal scores combine first; only their running sum, one row for
    each different score, is in one task, and rows are put in order score by score.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    totals = candidates.groupBy(F.col("score").alias("t_score")).agg(F.sum(size).alias("total"))
    above = totals.withColumn("above", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("t_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("above") <= limit).select("t_score", "above")
    inside = Window.partitionBy("score").orderBy("source_id", "target_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = candidates.join(above, F.col("score").eqNullSafe(F.col("t_score"))).withColumn("used", F.col("above") + F.sum(size).over(inside))
    return rows.where(F.col("used") <= limit).drop("t_score", "above")
