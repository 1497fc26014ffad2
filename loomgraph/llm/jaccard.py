"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document's set holds its distinct k-word shingles.  Sets are ordered rare
shingles first.  Two sets of sizes x and y whose Jaccard similarity reaches t
share at least o = ceil(t/(1+t)*(x+y)) shingles, so the first l shared ones lie
among the first x-o+l of the one and y-o+l of the other.  Each document picks
its own l out of MATCHES from an estimate of what its prefix will cost: index rows and
postings of the longer prefix against candidates, which are fewer for more
matches where rare shingles meet by chance, but not where frequent ones come
together in a family of near copies.  A pair is a candidate when it shares min(l, l') of
these prefix shingles, and is then verified on whole sets.  Before that, sets
are compared by their parities: PARITY bits, of which each shingle turns one
over.  Two sets differ in as many shingles as bits at least, and at the
threshold they may differ in x+y-2*o; pairs further apart go without loss.

Work that grows with the square of a group is avoided without losing a link:

1. Documents with equal sets collapse to one class.
2. In long posting lists classes are first paired with a few hubs of the list
   only, in rounds with other hubs each; verified links join components.
   Classes that share too few prefix shingles with any list for the matches asked
   of them are left out before, and lists of the same classes become one that
   counts as many times, at the first place any of them has in a class's prefix:
   a pair's count can only rise by that, so it loses no candidate.
3. Only then are all remaining pairs of a list taken, and of these just the
   pairs between different components: any other pair is connected already.
   Long lists are cut into blocks of bounded size that join block by block.

The shingle order needs no exact counts: any order that all documents share
gives the same links.  Counts are gathered from every document by lossy
counting (each run of documents reports the shingles that it saw `LOCAL` times
or more) and the `MAX_RANKED` most frequent ones are broadcast.

Cases: a null text, or one without words, has the empty set and links with
nothing; a text of fewer than k words is one shingle; null or equal ids and
repeated rows are fine (component_id is the least id of the component that is
not null, or null where there is none); an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import words
from loomgraph.llm.common import free_name, map_arrow, map_batches, materialise
from loomgraph.llm.components import components

#: Numbers of shared prefix shingles to choose from.
MATCHES = (1, 2, 4, 8, 16)
#: What one more index row costs, and how likely a shingle of unknown frequency is in another document,
#: both against comparing one shingle of a candidate.
ROW_COST, CHANCE = 20.0, 0.2
#: Shingles of one run of documents, and how often a run must see one to report it.
RUN, LOCAL = 1 << 21, 4
#: Bound of the broadcast frequency table (16 bytes each).
MAX_RANKED = 200_000
#: Rows of a posting list that meet in one group before its classes are known; frequent shingles are dealt to several.
PART = 512
#: Rows of a posting list in one block.
BLOCK = 1024
#: Lists from this size on meet hubs first: how many in a round, how many of them a class tries, rounds at most.
LONG, HUBS, TRIES, ROUNDS = 8, 8, 12, 2
#: Up to so many candidate classes (24 bytes each) are broadcast to fetch their texts; beyond, they are joined by a shuffle.
MAX_NEEDED = 400_000
#: Keys that a task remembers to leave out copies early.
SEEN = 1 << 16


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))


def _key(own: np.ndarray) -> int:
    """64 bits that equal sets share."""
    total = words.mix(own + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(words.mix(np.array([total], np.uint64)).view(np.int64)[0])


#: Bits of a set's parity, in words of 64.
PARITY = 256
PARITIES = [f"p{i}" for i in range(PARITY // 64)]


def _parity(own: np.ndarray) -> np.ndarray:
    """Which of PARITY bits an odd number of the set's shingles falls on, as words of 64 bits."""
    one, word = np.uint64(1) << (own & np.uint64(63)), (own >> np.uint64(6)) % np.uint64(len(PARITIES))
    return np.array([np.bitwise_xor.reduce(one[word == w]) if len(own) else 0 for w in range(len(PARITIES))], np.uint64).view(np.int64)


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for chunk in words.chunks(texts):
        cuts, values = chunk.shingles(chunk.word_hashes(lower=True), k)
        for i in range(chunk.n):
            yield chunk.first + i, values[cuts[i] : cuts[i + 1]]


def _survey(documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """kind 0: a document's id, body, key, set size n and parity; kind 1: a shingle (key) that a run saw n times."""
    slim = _texts(documents, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        kind = None

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL
            values, counts = values[often].view(np.int64), counts[often]
            none = pa.nulls(len(values))
            empty = [none.cast(pa.int64())] * len(PARITIES)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int8)), none.cast(kind), none.cast(pa.int64()), pa.array(values), pa.array(counts.astype(np.int64)), *empty], names=names)

        names = ["kind", "id", "body", "key", "n", *PARITIES]
        for batch in batches:
            kind = batch.column(0).type
            keys, sizes, parities = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros((len(PARITIES), batch.num_rows), np.int64)
            for row, own in _sets(batch.column(2), k):
                sizes[row] = len(own)
                if len(own):
                    keys[row] = _key(own)
                    parities[:, row] = _parity(own)
                    held.append(own)
                    size += len(own)
                if size >= RUN:
                    yield report()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), batch.column(0), batch.column(1), pa.array(keys), pa.array(sizes), *map(pa.array, parities)], names=names)
        if size:
            yield report()

    return map_arrow(slim, run, f"kind tinyint, id {slim.dtypes[0][1]}, body bigint, key bigint, n bigint, " + ", ".join(f"{p} bigint" for p in PARITIES))


class Order:
    """Rare-first order of shingles, and the prefix of a set under it."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, percent: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.percent = hashes[order], counts[order], percent
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.hashes >> np.uint64(42)] = True

    def prefix(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(prefix shingles in order, how often each was counted, the number of matches asked for)."""
        n = len(own)
        needed = -(-self.percent * n // 100)
        free = n - needed
        longest = min(n, free + MATCHES[-1])
        maybe = np.flatnonzero(self.sieve[own >> np.uint64(42)])
        seen = np.zeros(n, np.int64)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, own[maybe]), len(self.hashes) - 1)
            seen[maybe] = np.where(self.hashes[at] == own[maybe], self.counts[at], 0)
        rare = own[seen == 0]
        if len(rare) >= longest:
            ordered = rare[:longest]
            counts = cost = most_seen = np.zeros(longest)
        else:
            often = np.flatnonzero(seen)
            often = often[np.lexsort((own[often], seen[often]))]
            ordered = np.concatenate([rare, own[often]])[:longest]
            counts = np.concatenate([np.zeros(len(rare)), seen[often]])[:longest]
            cost, most_seen = np.cumsum(counts), np.maximum.accumulate(counts)
        best, least = 1, np.inf
        for l in MATCHES:
            if l > needed:
                break
            length = min(free + l, longest)
            postings, most = cost[length - 1], most_seen[length - 1]
            total = ROW_COST * length + postings + n * (CHANCE * length / l + most)
            if total < least:
                best, least = l, total
        return ordered[: free + best], counts[: free + best], best


#: An index row's set size, place in the prefix and number of matches, packed.
def _pack(n: int, places: np.ndarray, l: int) -> np.ndarray:
    return (np.int64(n) << 31) | (places << 5) | l


def _size(info: Column) -> Column:
    return F.shiftright(info, 31)


def _place(info: Column) -> Column:
    return F.shiftright(info, 5).bitwiseAND(F.lit((1 << 26) - 1))


def _matches(info: Column) -> Column:
    return info.bitwiseAND(F.lit(31))


def _index(documents: DataFrame, id_col: str, text_col: str, k: int, order) -> DataFrame:
    slim = _texts(documents, id_col, text_col).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, None] = OrderedDict()
        ranks = order.value
        for batch in batches:
            tokens, keys, infos, parts = [], [], [], []
            for _, own in _sets(batch.column(0), k):
                if not len(own):
                    continue
                key = _key(own)
                if key in seen:
                    seen.move_to_end(key)
                    continue
                seen[key] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                prefix, seen_times, l = ranks.prefix(own)
                tokens.append(prefix)
                keys.append(np.full(len(prefix), key, np.int64))
                infos.append(_pack(len(own), np.arange(len(prefix), dtype=np.int64), l))
                n_parts = (seen_times / PART).astype(np.int64) + 1
                parts.append(np.where(n_parts > 1, 1 + key % n_parts, 0))
            if tokens:
                flat = [np.concatenate(x) for x in (tokens, keys, infos, parts)]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), *(pa.array(x) for x in flat[1:])], names=["token", "key", "info", "part"])

    return map_arrow(slim, run, "token bigint, key bigint, info bigint, part bigint")


def _fits(x: Column, y: Column, p: Column, q: Column, percent: int) -> Column:
    """Whether the shingle at these places counts for the pair: sizes and parities near enough, both within the prefixes."""
    nx, ny = _size(x), _size(y)
    overlap = F.ceil((nx + ny) * percent / F.lit(100 + percent) - 1e-9)
    l = F.least(_matches(x), _matches(y))
    apart = sum((F.bit_count(p[c].bitwiseXOR(q[c])) for c in PARITIES), F.lit(0))
    return (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent) & (_place(x) < nx - overlap + l) & (_place(y) < ny - overlap + l) & (apart <= nx + ny - 2 * overlap)


def _candidates(pairs: DataFrame) -> DataFrame:
    """Pairs (a < b) that share as many prefix shingles as the less demanding of the two asks for."""
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("shared"), F.first("l").alias("l")).where(F.col("shared") >= F.col("l")).select("a", "b")


def _verify(pairs: DataFrame, classes: DataFrame, documents: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs of keys whose whole sets reach the threshold."""
    pairs = materialise(pairs)
    needed = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct().join(classes, "key").select("key", "id", "body")
    needed = materialise(needed)
    needed = F.broadcast(needed) if needed.count() <= MAX_NEEDED else needed.hint("shuffle_hash")
    texts = _texts(documents, id_col, text_col).alias("t").join(needed.alias("n"), (F.col("t.body") == F.col("n.body")) & F.col("t.id").eqNullSafe(F.col("n.id"))).select("key", "text")
    # A repeated row, or two rows with one id and text, would give the pair twice; links are made distinct later.
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = np.zeros(batch.num_rows, bool)
        for (row, x), (_, y) in zip(_sets(batch.column(2), k), _sets(batch.column(3), k), strict=True):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok[row] = 100 * shared >= percent * (len(x) + len(y) - shared)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return map_batches(both, check, "a bigint, b bigint")


def _labelled(rows: DataFrame, stars: DataFrame | None) -> DataFrame:
    """Index rows with the component that is known of their key."""
    rows = rows.select("token", "key", "info", "w", "held", "parity")
    if stars is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(stars.select(F.col("a").alias("key"), F.col("b").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _worth_hubs(rows: DataFrame) -> bool:
    """Whether the lists hold more pairs across components than a few for each row."""
    parts = rows.groupBy("token", "label").agg(F.count("*").cast("double").alias("m"))
    lists = parts.groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("within"))
    across, n = lists.agg(F.sum((F.col("m") * F.col("m") - F.col("within")) / 2), F.sum("m")).head()
    return bool(n) and across > 2 * n


def _with_list(rows: DataFrame, *of_list: Column) -> DataFrame:
    """The rows with aggregates of their token's list, which combine before their shuffle; the join on a hot token is left to adaptive splitting."""
    lists = rows.groupBy("token").agg(*of_list).withColumnRenamed("token", "t")
    return rows.join(lists, F.col("token") == F.col("t")).drop("t")


def _hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each class with the hubs, out of its lists', that it shares most lists with, if they are not connected yet.

    A list's classes are dealt anew in each round, and of each share the class with the most shared prefix shingles is
    the hub: it has the fewest shingles of its own, so it lies in the middle of its family and links with most of it.
    """
    dealt = F.pmod(F.xxhash64(F.lit(turn), "key"), F.lit(HUBS))
    hubs = [F.min(F.when(dealt == h, F.struct((-F.col("held")).alias("z"), "key", "info", "label", "parity"))) for h in range(HUBS)]
    fits = lambda hub: (F.col("label") != hub["label"]) & _fits(F.col("info"), hub["info"], F.col("parity"), hub["parity"], percent)
    near = F.transform(F.filter("hubs", fits), lambda hub: F.struct(hub["key"].alias("key"), F.least(_matches(F.col("info")), _matches(hub["info"])).alias("l")))
    met = _with_list(rows, F.array_compact(F.array(*hubs)).alias("hubs")).select("key", "w", near.alias("hubs")).where(F.size("hubs") > 0)
    # Only hubs that fit get rows, and lists where a class has the same ones count as one: near copies share whole runs of lists.
    met = met.groupBy("key", "hubs").agg(F.sum("w").alias("w")).select("key", "w", F.explode("hubs").alias("hub")).select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b"), "key", "w", "hub.l")
    # Lists have different hubs, so a part of the matches asked for is enough here; a wrong guess costs one verification.
    counted = met.groupBy("key", "a", "b").agg(F.sum("w").alias("shared"), F.first("l").alias("l")).where(F.col("shared") * 4 >= F.col("l"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "a", "b"))
    return counted.withColumn("best", best).where(F.col("best") <= TRIES).select("a", "b").distinct()


def survey(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(documents: id, body, key, n; components: key, component) where component is a key and keys without links are left out."""
    seen = materialise(_survey(documents, id_col, text_col, k))
    docs = seen.where("kind = 0").select("id", "body", "key", "n")
    often = seen.where("kind = 1").groupBy("key").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "key").limit(MAX_RANKED).toArrow()
    order = documents.sparkSession.sparkContext.broadcast(Order(often.column("key").to_numpy().view(np.uint64), often.column("c").to_numpy(), percent))
    classes = docs.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id", "body")).alias("r")).select("key", "r.id", "r.body")
    parities = seen.where("kind = 0 AND n > 0").groupBy("key").agg(*(F.min(p).alias(p) for p in PARITIES)).select("key", F.struct(*PARITIES).alias("parity"))

    # Most shingles are in one class only and go here; rows of frequent ones stay, dealt to several groups.
    few = Window.partitionBy("token", "part")
    index = _index(documents, id_col, text_col, k, order)
    shared = index.withColumn("low", F.min("key").over(few)).withColumn("high", F.max("key").over(few)).where("part > 0 OR low != high").select("token", "part", "key", "info").distinct()
    shared = materialise(shared.select("token", "key", "info"))
    least = F.min(_matches(F.col("info"))).alias("least")
    members = F.expr("bit_xor(xxhash64(key))").alias("members")
    shared = _with_list(shared, F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("size"), least, members).where("low != high")
    # Lists of the same classes become one, which counts as many times; near copies share whole runs of shingles.
    shared = shared.groupBy(F.xxhash64("members", "size").alias("token"), "key").agg(F.min("info").alias("info"), F.max("size").alias("size"), F.min("least").alias("asked"), F.count("*").alias("w"))
    # No pair of a class asks for fewer matches than the least of its lists does; a class with fewer shared shingles has no pair.
    own = Window.partitionBy("key")
    shared = shared.withColumn("held", F.sum("w").over(own)).withColumn("asked", F.min("asked").over(own)).where("held >= asked").select("token", "key", "info", "size", "w", "held")
    shared = materialise(shared.join(parities, "key"))

    verify = lambda pairs: _verify(pairs, classes, documents, id_col, text_col, k, percent)
    found = stars = None
    for turn in range(ROUNDS):
        rows = _labelled(shared.where(F.col("size") >= LONG), stars)
        if not _worth_hubs(rows):
            break
        links = materialise(verify(_hub_pairs(rows, turn, percent)))
        found = links if found is None else found.unionAll(links)
        stars = components(found, settled=False)
    labelled = materialise(_labelled(shared, stars))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low != high").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_rows = labelled.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    left = open_rows.select("token", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("key").alias("a"), F.col("info").alias("x"), F.col("label").alias("p"), F.col("parity").alias("r"), "w")
    right = open_rows.select("token", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("key").alias("b"), F.col("info").alias("y"), F.col("label").alias("q"), F.col("parity").alias("s"))
    pairs = left.join(right, ["token", "i", "j"]).where((F.col("p") != F.col("q")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & _fits(F.col("x"), F.col("y"), F.col("r"), F.col("s"), percent))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", F.least(_matches(F.col("x")), _matches(F.col("y"))).alias("l"))
    rest = verify(_candidates(pairs))
    final = components(rest if found is None else rest.unionAll(found))
    return docs, final.select(F.col("a").alias("key"), F.col("b").alias("component"))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document row: the id, n_shingles and component_id."""
    docs, parts = survey(documents, id_col=id_col, text_col=text_col, k=k, percent=percent)
    by_key = docs.where("n > 0").groupBy("key").agg(F.min("id").alias("least")).join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = by_key.groupBy("component").agg(F.min("least").alias("component_id"))
    names = by_key.select("key", "component").join(named, "component").select(F.col("key").alias("k"), "component_id")
    linked = docs.join(names, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one row of each component (the least id) left; texts without words all stay."""
    docs, parts = survey(documents, id_col=id_col, text_col=text_col, k=k, percent=percent)
    rows = docs.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "body")).alias("r")).join(parts, "key", "left").groupBy(F.coalesce("component", "key").alias("c")).agg(F.min("r").alias("r"))
    c_id, c_body = free_name(documents, "c_id"), free_name(documents, "c_body")
    chosen = rows.select(F.col("r.id").alias(c_id), F.col("r.body").alias(c_body))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    body = F.xxhash64(text_col)
    kept = documents.where(worded).join(chosen.hint("shuffle_hash"), (body == F.col(c_body)) & documents[id_col].eqNullSafe(F.col(c_id)), "left_semi")
    if docs.where("n > 0").groupBy("id", "body").count().where("count > 1").limit(1).count():
        kept = kept.withColumn(c_body, body).dropDuplicates([id_col, c_body]).drop(c_body)
    return kept.unionAll(documents.where(~worded))
