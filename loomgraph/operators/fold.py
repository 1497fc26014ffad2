"""The fold of node updates as aggregates that combine, over pieces that merge.

A piece says what a run of consecutive updates does to a node: a single update
is one, so is all that one file says of a node, and so is a whole node.  combine()
makes one piece of many; which pieces come together first does not matter, as
long as their updates do not interleave, so what was folded apart (in another
shard, in an earlier batch) merges into what one fold gives.

What an update does, in order: the type is its own; the name becomes its own if
that is longer; the description becomes its own unless it is a shorter one of a
business rule; a metadata key takes its value, but objects merge key by key, one
level deep; an origin that is given stays until the next; files add up.

Each of these is the last, the longest or the union of something, so that no
array of a node's updates is ever made: a node that a third of all rows update
costs one row of each task.  Two of them look back only to a last reset (a
description to the last update of another type, a key to its last value that is no
object); where a node has both kinds of updates, the reset is found first and
joined back, a join on the node that adaptive execution may split.

Columns of a piece: id, ord and last (places of its first and last update, of any
type that has an order), n (updates), type, name, description, resets (whether it
replaces the description whatever the length), origin, files, and metadata, a map
from keys to (fresh, object, json): whether the value replaces what was there
before the piece, whether it is an object, and the value as JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE = "struct<fresh: boolean, object: boolean, json: string>"
#: Updates of one node whose origins one task looks at in order, see accepted().
BAND = 1 << 16


def _text(c: str | Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _values(metadata: str) -> Column:
    """Metadata as (key -> value): a JSON object's members; null or no object: none."""
    entries = F.map_entries(F.from_json(metadata, "map<string,variant>"))
    one = lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json"))
    object_ = lambda j: F.startswith(j, F.lit("{"))
    as_value = lambda e: F.struct(e["key"].alias("key"), F.struct((~object_(e["json"])).alias("fresh"), object_(e["json"]).alias("object"), e["json"].alias("json")).alias("value"))
    return F.coalesce(F.map_from_entries(F.transform(F.transform(entries, one), as_value)), F.create_map().cast(f"map<string, {VALUE}>"))


def _flat_values(metadata: str) -> Column:
    """The same for a map of strings, none of which is an object."""
    given = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    return F.transform_values(given, lambda k, v: F.struct(F.lit(True).alias("fresh"), F.lit(False).alias("object"), v.alias("json")))


def pieces_of(updates: DataFrame, ord_col: str = "ord") -> DataFrame:
    """A piece for each update (id, ord, type, name, description, metadata as JSON or map of strings, origin, source_file)."""
    json = dict(updates.dtypes)["metadata"] == "string"
    return updates.select(
        "id", F.col(ord_col).alias("ord"), F.col(ord_col).alias("last"), F.lit(1).cast("bigint").alias("n"), "type", _text("name").alias("name"), _text("description").alias("description"),
        (F.coalesce("type", F.lit("")) != "business_rule").alias("resets"), "origin", F.array(F.coalesce("source_file", F.lit("unknown"))).alias("files"), (_values if json else _flat_values)("metadata").alias("metadata"),
    )


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"m_{k}"]) for k in keys))


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under other names, for a join."""
    return reduce(lambda x, k: x.withColumnRenamed(k, f"m_{k}"), keys, df)


def _metadata(pieces: DataFrame, keys: list[str], nested: bool) -> DataFrame:
    """(keys as m_.., metadata) of each group.

    The latest of each member comes first, whatever was reset: a member whose latest is older than the reset has no
    later one that could stay.  So nothing is joined back, and only what differs by member goes on.
    """
    rows = pieces.select(*keys, "last", F.explode("metadata").alias("key", "v")).select(*keys, "last", "key", "v.*")
    is_scalar = ~F.col("object")
    if nested:
        # A row for each member of an object; one without a member for a scalar and for an object that has none.
        rows = rows.select(*keys, "last", "key", "fresh", "object", F.when(is_scalar, F.col("json")).alias("scalar"), F.explode_outer(F.when(F.col("object"), F.from_json("json", "map<string,variant>"))).alias("member", "of_member"))
        rows = rows.select(*keys, "last", "key", "member", "fresh", "object", F.when(F.col("member").isNotNull(), F.to_json("of_member")).otherwise(F.col("scalar")).alias("text"))
        says = F.when(F.col("member").isNotNull() | is_scalar, F.col("last"))
    else:
        rows = rows.select(*keys, "last", "key", F.lit(None).cast("string").alias("member"), "fresh", "object", F.col("json").alias("text"))
        says = F.when(is_scalar, F.col("last"))
    latest = rows.groupBy(*keys, "key", "member").agg(F.max("last").alias("last"), F.max_by("object", "last").alias("object"), F.max_by("text", says).alias("text"), F.max(F.when(F.col("fresh"), F.col("last"))).alias("reset"))
    # As many rows as a node has different keys and members meet by the node.
    of_key = [F.max_by("object", "last").alias("object"), F.max(F.when(F.col("member").isNull(), F.col("text"))).alias("json"), F.max("reset").alias("reset")]
    if nested:
        of_key.append(F.collect_list(F.when(F.col("member").isNotNull(), F.struct("member", "text", "last"))).alias("members"))
    per = latest.repartition(*keys).groupBy(*keys, "key").agg(*of_key)
    text = F.col("json")
    if nested:
        live = F.array_sort(F.filter("members", lambda m: F.col("reset").isNull() | (m["last"] >= F.col("reset"))))
        # Names without anything to escape are put together as text, which takes a fraction of the time.
        plain = F.concat(F.lit("{"), F.array_join(F.transform(live, lambda m: F.concat(F.lit('"'), m["member"], F.lit('":'), m["text"])), ","), F.lit("}"))
        escaped = F.to_json(F.map_from_entries(F.transform(live, lambda m: F.struct(m["member"].alias("key"), F.parse_json(m["text"]).alias("value")))))
        whole = F.when(F.forall("members", lambda m: m["member"].rlike("^[A-Za-z0-9_ .-]*$")), plain).otherwise(escaped)
        text = F.when(F.col("object"), whole).otherwise(text)
    value = F.struct(F.col("reset").isNotNull().alias("fresh"), F.col("object"), text.alias("json"))
    return _marked(per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value.alias("value"))))).alias("metadata")), keys)


def combine(pieces: DataFrame, keys: tuple[str, ...] = ("id",), nested: bool = True) -> DataFrame:
    """One piece for each value of the keys; the keys are among the columns, others of the pieces are dropped.

    nested=False leaves out the merge of objects, for metadata that has none.
    """
    keys = list(keys)
    plain, resets = F.when(~F.col("resets"), F.col("last")), F.when(F.col("resets"), F.col("last"))
    out = pieces.groupBy(*keys).agg(
        F.min("ord").alias("ord"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max_by("type", "last").alias("type"), F.min_by("name", F.struct(-F.length("name"), F.col("ord"))).alias("name"),
        F.max(resets).alias("reset"), F.max(plain).alias("last_plain"), F.max_by("description", resets).alias("reset_text"), F.max_by("description", F.when(~F.col("resets"), F.struct(F.length("description"), F.col("last")))).alias("plain_text"),
        F.max_by("origin", F.when(F.col("origin").isNotNull(), F.col("last"))).alias("origin"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("files"),
    )
    # Where plain updates follow a reset, the longest of these decides.
    mixed = _marked(out.where(F.col("last_plain") > F.col("reset")).select(*keys, "reset"), keys)
    after = pieces.where(~F.col("resets")).join(mixed, _same(pieces, mixed, keys)).where(F.col("last") > F.col("reset"))
    after = _marked(after.groupBy(*keys).agg(F.max_by("description", F.struct(F.length("description"), F.col("last"))).alias("later")), keys)
    out = out.join(after, _same(out, after, keys), "left").drop(*(f"m_{k}" for k in keys))
    text = F.when(F.col("reset").isNull(), F.col("plain_text")).when(F.length("later") >= F.length("reset_text"), F.col("later")).otherwise(F.col("reset_text"))
    meta = _metadata(pieces, keys, nested)
    empty = F.create_map().cast(f"map<string, {VALUE}>")
    return out.join(meta, _same(out, meta, keys), "left").select(*keys, "ord", "last", "n", "type", "name", text.alias("description"), F.col("reset").isNotNull().alias("resets"), "origin", "files", F.coalesce("metadata", empty).alias("metadata"))


def nodes_of(pieces: DataFrame, flat: bool = False) -> DataFrame:
    """Nodes (id, ord, type, name, description, metadata, origin, source_origins, is_merged) of pieces that are whole nodes; metadata as JSON, or as a map of strings if `flat`."""
    value = lambda k, v: v["json"]
    # Keys of a node in order, so that equal nodes have equal texts.
    json = F.to_json(F.transform_values("metadata", lambda k, v: F.parse_json(v["json"])))
    return pieces.select("id", "ord", "type", "name", "description", (F.transform_values("metadata", value) if flat else json).alias("metadata"), F.coalesce("origin", F.lit("unknown")).alias("origin"), F.col("files").alias("source_origins"), (F.col("n") > 1).alias("is_merged"))


def accepted(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates that take effect, updates that a lock keeps out) of updates with id, ord (a bigint, different for each of a node), origin and caller.

    An agent may not change a node whose origin is documentation at that point.
    The origin there was set by the last update before it that sets one, or by an
    agent's that sets documentation: agents' other origins count only where they
    pass, and then leave the node open as it was.  Only nodes that an agent writes
    to are looked at, in bands of BAND places: the last origin inside a band, or
    else that of the bands before it.
    """
    agent = F.coalesce("caller", F.lit("")) == "agent"
    marked = updates.where(agent).select(F.col("id").alias("m_id")).distinct()
    locks = F.when(agent & (F.col("origin") == "documentation"), F.lit(True)).when(~agent & F.col("origin").isNotNull(), F.col("origin") == "documentation")
    rows = updates.join(marked, F.col("id").eqNullSafe(F.col("m_id")), "left_semi").select("id", "ord", F.floor(F.col("ord") / BAND).alias("band"), locks.alias("locks"), agent.alias("agent"))
    before = Window.partitionBy("id", "band").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where("agent or locks is not null").withColumn("inside", F.last("locks", ignorenulls=True).over(before)).where("agent")
    bands = rows.where("locks is not null").groupBy("id", "band").agg(F.max_by("locks", "ord").alias("at_end")).unionByName(rows.where("agent").select("id", "band", F.lit(None).cast("boolean").alias("at_end")).distinct())
    bands = bands.groupBy("id", "band").agg(F.bool_or("at_end").alias("at_end"))
    earlier = Window.partitionBy("id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(F.col("id").alias("b_id"), F.col("band").alias("b_band"), F.last("at_end", ignorenulls=True).over(earlier).alias("above"))
    found = inside.join(bands, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("band") == F.col("b_band")))
    kept_out = found.where(F.coalesce("inside", "above", F.lit(False))).select(F.col("id").alias("k_id"), F.col("ord").alias("k_ord"))
    same = updates["id"].eqNullSafe(kept_out["k_id"]) & (updates["ord"] == kept_out["k_ord"])
    return updates.join(kept_out, same, "left_anti"), updates.join(kept_out, same, "left_semi")
