"""Connected components of a link table, wholly distributed.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every round replaces links by links to a
smaller neighbour until only stars remain.  Minima combine before the shuffle.
The joins are sort-merge joins however small the links are: a broadcast in each
of so many short queries would fill the driver's memory with tables that are
used once.  Each star reads its links in one place for the minima and in one for
the join, so the plan of two stars in a row holds the first one twice, not eight
times.  The links of a round are written to the shared folder, so plans stay
short and a lost executor repeats one round at most.

Cases: empty input gives an empty table; self-links and repeated links are
dropped; nulls are not linked with anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b) for each of the named pairs of columns, in one pass over the rows."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each vertex's larger (or smaller) neighbours linked with the least vertex around it."""
    ways = _each(links, ("a", "b"), ("b", "a"))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = ways.join(least.withColumnRenamed("a", "c").hint("merge"), F.col("a") == F.col("c"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = _each(joined.where(F.col("b") < F.col("a")), ("b", "m"), ("a", "m"))
    return out.where(F.col("a") != F.col("b")).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(links: DataFrame, max_rounds: int = 40, settled: bool = True) -> DataFrame:
    """(a, b): every vertex that has a link, and the least vertex of its component.

    With settled=False two rounds are made and no more: b is then some vertex of
    the component, often the least one, but not always the same for all of it.
    """
    links = materialise(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    if not settled:
        links = materialise(_star(_star(links, large=True), large=False))
        links = _star(_star(links, large=True), large=False).groupBy("a").agg(F.min("b").alias("b"))
        return materialise(_each(links, ("a", "b"), ("b", "b")).groupBy("a").agg(F.min("b").alias("b")))
    before = _digest(links)
    for _ in range(max_rounds if before[0] else 0):
        links = materialise(_star(_star(links, large=True), large=False))
        now = _digest(links)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("links have not settled")
    return links.unionAll(links.select(F.col("b").alias("a"), "b").distinct())
