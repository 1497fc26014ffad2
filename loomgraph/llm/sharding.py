"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS places.  A row's place is a hash of its id and text; every
shard stands at `vnodes` hashed places and owns the places up to each of them.
Loads are bounded by a capacity in rows or in bytes.  A shard first accepts its
own keys in ring order until it is full; what is left over then continues
clockwise, in ring order too, past full shards to the next ones with room.  So
the balance is guaranteed and only overflow moves: the capacity is `load_factor`
times the mean, and at 1 the capacities add up to the load exactly, which puts
the row counts at most one apart.  A capacity in bytes may be exceeded by less
than a row for each piece of the shard.

Only totals of cells reach the driver: at most CELLS of them, plus one for each
further part of a cell that holds more than `part_rows` rows (equal rows share
a cell, and may be a third of all).  The driver cuts the cells' loads into
pieces, a piece to a shard, and each row finds its piece by the load before it
in its part of the cell.

Laws: `rows` (counts at most one apart) or `bytes` (sizes near equal).  Groups of equal texts are not kept together.

Cases: a null text counts as empty (8 bytes, CRC of nothing); null ids and
repeated rows are placed like any others; with fewer rows than shards some
shards stay empty; an empty table gives an empty table; other columns are
ignored by place() and kept by shard_documents().
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import free_name, materialise, repeated

#: Places on the ring (a power of two).
CELLS = 1 << 16


def vnode_cells(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise; a shard's places do not depend on the other shards."""
    places = [(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS, s) for s in range(shards) for v in range(vnodes)]
    return sorted(places)


def fill(parts: list[tuple[int, int, int]], shards: int, vnodes: int, load_factor: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, part, low, high, shard) that cover the load of every part.

    `parts` are (cell, part, load) in ring order.
    """
    ring = vnode_cells(shards, vnodes)
    total = sum(p[2] for p in parts)
    room = [total // shards + (s < total % shards) for s in range(shards)] if load_factor == 1 else [math.ceil(total * load_factor / shards)] * shards
    pieces, over = [], []
    at = 0
    for cell, part, size in parts:
        while at < len(ring) and ring[at][0] < cell:
            at += 1
        node = at % len(ring)
        shard = ring[node][1]
        own = min(size, room[shard])
        room[shard] -= own
        if own or not size:
            pieces.append((cell, part, 0, own, shard))
        if own < size:
            over.append((cell, part, own, size, node))
    for cell, part, low, high, node in over:
        passed = 0
        while low < high:
            node, passed = (node + 1) % len(ring), passed + 1
            shard = ring[node][1]
            if room[shard] <= 0:
                if passed > len(ring):
                    raise RuntimeError("the capacities are below the total")
                continue
            take = min(high - low, room[shard])
            room[shard] -= take
            pieces.append((cell, part, low, low + take, shard))
            low, passed = low + take, 0
    return sorted(pieces)


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def place(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", law: str = "rows", shards: int = 24, vnodes: int = 256, load_factor: float = 1.0, part_rows: int = 50_000) -> DataFrame:
    """One row per document row: the id, size, text_crc32, shard, slot (from 0 in each shard) and body (hash of the text)."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    spark = documents.sparkSession
    text = F.col(text_col)
    load = F.lit(1).cast("bigint") if law == "rows" else F.col("size")
    body = F.xxhash64(F.coalesce(text, F.lit("")))
    base = documents.select(
        F.col(id_col).alias("id"), row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"), body.alias("body"), F.xxhash64(F.col(id_col), body).alias("h")
    )
    cell = F.shiftrightunsigned("h", 64 - CELLS.bit_length() + 1).cast("int")
    rows = materialise(base.withColumn("cell", cell).withColumn("row", F.monotonically_increasing_id()))
    # The bound of what reaches the driver: CELLS, and one for each full part.
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    n_rows = counts.agg(F.sum("n")).head()[0] or 0
    limit = max(part_rows, 8 * n_rows // CELLS)
    hot = counts.where(F.col("n") > limit).select(F.col("cell").alias("hot"), F.ceil(F.col("n") / limit).cast("int").alias("parts")).toArrow()
    if hot.num_rows:
        table = F.broadcast(spark.createDataFrame(hot))
        rows = rows.join(table, F.col("cell") == F.col("hot"), "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    totals = rows.groupBy("cell", "part").agg(F.sum(load).alias("b")).orderBy("cell", "part").toArrow().to_pydict()
    pieces = fill(list(zip(totals["cell"], totals["part"], totals["b"], strict=True)), shards, vnodes, load_factor)
    kind = pa.schema([("p_cell", pa.int32()), ("p_part", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("shard", pa.int32())])
    columns = zip(*pieces, strict=True) if pieces else [[]] * 5
    cut = F.broadcast(spark.createDataFrame(pa.table([pa.array(c, t.type) for c, t in zip(columns, kind, strict=True)], schema=kind)))

    inside = Window.partitionBy("cell", "part").orderBy("h", "id", "size", "row")
    placed = rows.withColumn("before", F.sum(load).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - load)
    placed = placed.join(cut, (F.col("cell") == F.col("p_cell")) & (F.col("part") == F.col("p_part")) & (F.col("before") >= F.col("low")) & (F.col("before") < F.col("high"))).select("id", "size", "text_crc32", "body", "h", "row", "cell", "part", "shard")
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "part", "shard").orderBy("h", "id", "size", "row")) - 1)
    placed = materialise(placed)
    # A slot is the rows of the shard in earlier cells, at most one count for each piece, and the rank inside the piece.
    sizes = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    start = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    start = F.broadcast(start.select(F.col("shard").alias("s"), F.col("cell").alias("c"), F.col("part").alias("p"), "start"))
    slot = (F.col("start") + F.col("rank")).cast("bigint").alias("slot")
    return placed.join(start, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p"))).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot, "body")


def shard_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, with size, text_crc32, shard and slot (in place of columns of these names)."""
    names = [c for c in documents.columns if c not in ("size", "text_crc32", "shard", "slot")]
    if repeated(documents, id_col, text_col):
        # Rows that id and text do not tell apart are numbered, and written so that the numbers stay.
        number = free_name(documents, "row")
        documents = materialise(documents.withColumn(number, F.monotonically_increasing_id()))
        placed = place(documents, id_col=number, text_col=text_col, **options).withColumnRenamed(number, "p_id")
        joined = documents.join(placed, documents[number] == placed["p_id"])
    else:
        placed = place(documents, id_col=id_col, text_col=text_col, **options).withColumnRenamed(id_col, "p_id")
        body = F.xxhash64(F.coalesce(documents[text_col], F.lit("")))
        joined = documents.join(placed, (body == placed["body"]) & documents[id_col].eqNullSafe(placed["p_id"]))
    return joined.select(*(documents[c] for c in names), placed["size"], placed["text_crc32"], placed["shard"], placed["slot"])
