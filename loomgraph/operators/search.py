"""BM25 search over names and descriptions of nodes."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shared import materialise
from loomgraph.functions.text import search_tokens

#: Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs: DataFrame, query: list[str], *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score) of all documents; a term that most documents hold takes EPSILON times the mean IDF of all terms.

    Statistics cover the whole collection; documents without any of the query's terms are left out.
    """
    wanted = Counter(query)
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
    # Texts are read once: of each stay its length, its distinct terms, and how often it has the query's.
    terms = F.array(*map(F.lit, wanted))
    tokens = docs.select(F.col(id_col).alias("id"), search_tokens(text_col).alias("tokens"))
    times = F.transform(terms, lambda q: F.size(F.filter("tokens", lambda t: t == q)))
    base = materialise(tokens.select("id", F.size("tokens").alias("dl"), F.array_distinct("tokens").alias("terms"), times.alias("tf")), "bm25")
    df = base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # One row: the mean IDF of all terms, and the counts of the query's.
    of_query = F.map_from_entries(F.collect_list(F.when(F.col("term").isin(*wanted), F.struct("term", "df"))))  # as many as the query has
    found = df.crossJoin(F.broadcast(stats)).agg(F.first("n"), F.first("avgdl"), F.avg(raw), of_query).head()  # a single row joined
    if not found[0] or not found[1]:
        return base.select("id", F.lit(0.0).alias("score"))
    n, avgdl, mean, held = found
    score = F.lit(0.0)
    for i, (term, weight) in enumerate(wanted.items()):
        if term in held:
            idf = math.log(n - held[term] + 0.5) - math.log(held[term] + 0.5)
            tf = F.col("tf")[i]
            score = score + weight * (EPSILON * mean if idf < 0 else idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    return base.where(F.exists("tf", lambda x: x > 0)).select("id", score.alias("score"))


def search(nodes: DataFrame, query: str, kind: str | None = None, top: int = 20) -> DataFrame:
    """The best nodes with a score above 0, ties in input order; for an empty query the first 50."""
    if kind:
        nodes = nodes.where(F.col("type") == kind)
    spark = nodes.sparkSession
    words = spark.range(1).select(search_tokens(F.lit(query)).alias("t")).head()[0]
    if not words:
        return nodes.orderBy("ord").limit(50).withColumn("score", F.lit(0.0))
    text = nodes.withColumn("text", F.concat_ws(" ", "name", "description"))
    scores = bm25(text, words)
    return nodes.join(scores, "id").where("score > 0").orderBy(F.desc("score"), "ord").limit(top)
