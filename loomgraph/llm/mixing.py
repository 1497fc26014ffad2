"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Targets: sources in code-point order (null last) carry the weights in turn and
share all words by them; a source's target stops at `max_repeats` times its
size, and the excess is shared out again by weight.  This is one water level,
found from sources ordered by the ratio of limit to weight.

Schedule: the mix is a run of slots of equal token blocks.  Slot k has the
golden-ratio point frac(k * phi), here as integers modulo 2**31, which falls
into one source's stretch of the cumulative targets.  Slots are ranked per
source, and the r-th slot of a source takes the r-th block of the source's
shuffled word stream, which starts over when it ends.  A document takes the
words of its pieces in the blocks that were scheduled.

Streams and ranks are running sums in two levels: inside buckets of bounded
share, and over the buckets' totals, so no task holds a source's rows.  The
shuffle order is a hash of id, text and seed; runs agree.

Cases: null or wordless texts have size 0 and take nothing; a null source is a
source of its own; a table without words has targets 0 and takes nothing; null
and equal ids and repeated rows each have their own share; an empty table gives
an empty table; other columns are ignored by mix() and kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, free_name, materialise, repeated

#: Points of the schedule's circle, and the odd number next to 2**31 / golden ratio (fixed values of the sequence).
CIRCLE, STEP = 1 << 31, 1327217885
#: Equal parts of the circle by which slots meet sources.
GUIDE = 4096
#: Shuffle buckets of a source, and slots in a run.
BUCKETS, RUN = 1024, 1 << 14
#: Up to so many sources their table is broadcast; beyond, it is joined by a shuffle.
MAX_BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row for a source."""
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    shares = sizes.withColumn("w", w).withColumn("total", F.sum("source_size").over(everything)).withColumn("limit", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    shares = shares.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("w").over(onward))
    # The first source whose own share at its level is within its limit sets the level of all that follow.
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(everything)
    return shares.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("w"), F.col("limit").cast("double")))).select("source", "source_size", "target")


def _schedule(wanted: DataFrame, slots: int, few: bool) -> DataFrame:
    """(source_no, rank) of each slot, rank from 0 in each source."""
    spark = wanted.sparkSession
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    edge = F.floor(F.coalesce(F.try_divide(F.sum("target").over(upto), F.sum("target").over(whole)), F.lit(0.0)) * CIRCLE + 0.5).cast("bigint")
    arcs = wanted.withColumn("high", edge).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0))).where("high > low")
    part = CIRCLE // GUIDE
    guide = arcs.select("source_no", "low", "high", F.explode(F.sequence((F.col("low") / part).cast("int"), ((F.col("high") - 1) / part).cast("int"))).alias("g"))
    guide = F.broadcast(guide) if few else guide
    k = spark.range(slots)
    u = F.pmod(F.pmod(F.col("id"), F.lit(CIRCLE)) * F.lit(STEP), F.lit(CIRCLE))
    hits = k.withColumn("u", u).withColumn("h", (F.col("u") / part).cast("int")).join(guide, (F.col("h") == F.col("g")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("id", "source_no", (F.col("id") / RUN).cast("bigint").alias("run"))
    runs = hits.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    start = runs.withColumn("start", F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("id")) - 1
    return hits.withColumn("inside", inside).join(start, ["source_no", "run"]).select("source_no", (F.col("start") + F.col("inside")).alias("rank"), F.col("id").alias("slot"))


def mix(documents: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 0, max_block: int = 1 << 16, slots_per_source: int = 4096) -> DataFrame:
    """One row per document row: the id, size, source_size, target, taken, copies (takes that begin it) and body (hash of the text)."""
    body = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    base = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), body.alias("body"))
    base = base.withColumn("h", F.xxhash64(F.lit(seed), "id", "body")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(base)
    # One row for each source and bucket, then one for each source.
    totals = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("b_size")))
    wanted = targets(totals.groupBy("source").agg(F.sum("b_size").alias("source_size")), tuple(weights), max_repeats)
    wanted = materialise(wanted.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    n_sources, total = wanted.agg(F.count("*"), F.sum("source_size")).head()
    total = total or 0
    block = max(1, min(max_block, total // max(1, n_sources * slots_per_source)))
    few = n_sources <= MAX_BROADCAST_SOURCES
    schedule = _schedule(wanted, -(-total // block), few)

    named = wanted.select(F.col("source").alias("w_source"), "source_no", "source_size", "target")
    named = F.broadcast(named) if few else named
    start = totals.withColumn("b_start", F.sum("b_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b_size")).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_no"), "b_start")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "id", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("inside", inside).join(start, (F.col("bucket") == F.col("b_no")) & F.col("source").eqNullSafe(F.col("b_source"))).join(named, F.col("source").eqNullSafe(F.col("w_source")))
    placed = placed.select("row", "id", "body", "size", "source_no", "source_size", "target", (F.col("b_start") + F.col("inside")).alias("at"))
    placed = materialise(placed)

    # Pieces: each turn of the stream, cut at block borders.
    turns = placed.where("size > 0").select("row", "source_no", "size", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn"), "at", "source_size")
    turns = turns.withColumn("low", F.col("at") + F.col("turn") * F.col("source_size")).withColumn("high", F.col("low") + F.col("size"))
    pieces = turns.select("row", "source_no", "low", "high", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")).alias("b"))
    piece = F.least("high", (F.col("b") + 1) * block) - F.greatest("low", F.col("b") * block)
    begins = (F.col("low") >= F.col("b") * block).cast("int")
    taken = pieces.withColumn("piece", piece).withColumn("begins", begins).join(schedule.select(F.col("source_no").alias("s"), "rank"), (F.col("source_no") == F.col("s")) & (F.col("b") == F.col("rank")))
    taken = taken.groupBy("row").agg(F.sum("piece").alias("taken"), F.sum("begins").alias("copies"))
    return placed.join(taken, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"), "body"
    )


def mixed_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, once for each turn in which the mix begins them (not at all, or up to max_repeats times)."""
    names = documents.columns
    if repeated(documents, id_col, text_col):
        # Rows that id and text do not tell apart are numbered, and written so that the numbers stay.
        number = free_name(documents, "row")
        documents = materialise(documents.withColumn(number, F.monotonically_increasing_id()))
        taken = mix(documents, id_col=number, text_col=text_col, **options).where("copies > 0").withColumnRenamed(number, "t_id")
        joined = documents.join(taken, documents[number] == taken["t_id"])
    else:
        taken = mix(documents, id_col=id_col, text_col=text_col, **options).where("copies > 0").withColumnRenamed(id_col, "t_id")
        body = F.xxhash64(F.coalesce(documents[text_col], F.lit("")))
        joined = documents.join(taken, (body == taken["body"]) & documents[id_col].eqNullSafe(taken["t_id"]))
    turn = F.explode(F.sequence(F.lit(1), taken["copies"])).alias(free_name(documents, "turn"))
    return joined.select(*(documents[c] for c in names), turn).select(*(F.col(f"`{c}`") for c in names))
