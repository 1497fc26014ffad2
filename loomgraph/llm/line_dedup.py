"""Line dedup by a deletion-neighbourhood join, or for two edits by a join of segments.

Two lines are alike when their edit distance (code points inserted, deleted or
replaced) is at most `max_edits`, 0, 1 or 2, and at most one for every
`min_chars` code points of the shorter.  Of alike lines the earliest stays: an
occurrence goes when its line occurred before, or when an alike line first
occurred before this line's first occurrence.  Documents come in id order (null
last), then by a hash of the text; lines in the order of the text.

1. Equal lines meet by a 128-bit hash; minima combine before the shuffle, so a
   line that every document has costs one row a task.
2. One edit leaves the first or the last half of a line as it was.  Lines are
   keyed by their halves, cut for their own length and for one less; only lines
   that share such a key with another line go on.  This loses none.
3. These emit their deletion neighbourhood as hashed keys: the line, and the
   line without each one of its code points, with the place.  All are made from
   two running hashes, without building the strings.  Lines that equal one
   another but for one code point share a key and a place; where one lacks a
   code point of the other, it is itself a key of the other.  Every line of a
   key is compared with the earliest one only, never pair by pair: whatever
   shares key and place is alike, so that one decides.
4. Candidates fetch their texts and are verified by edit distance.

Two edits: a line cut into parts has at most two parts that are touched.  What
lies before, between and behind them is as it was, the middle moved by at most
one point, and makes a key with the lesser length of the pair.  Three parts
sieve the lines.  Those that go on meet by their keys of 6 parts; lines of a key
that more than MAX_GROUP share meet by 24 parts instead, where all but a twelfth
of a line is equal, and only by keys whose two parts lie in the pair of parts that many
share.  Pairs of a key whose parities allow two edits (which code
points and pairs of them a line holds an odd number of times; an edit changes
few) are verified by edit distance; keys that the same lines share are taken as
one, so that a pair meets once for each such set of lines; in a large
group of the last keys the earliest line comes first, and only lines that it
does not decide are compared with the others.

Lines without a word are never dropped; lines shorter than `min_chars` code
points are compared for equality only (one edit changes too much of them).

Cases: null or empty texts have no lines; nulls and equal ids and repeated rows
are ordered as above, further ties arbitrarily but once; an empty table gives an
empty table; other columns are ignored by dedup() and kept by drop_lines().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import words
from loomgraph.llm.common import free_name, map_batches, materialise, repeated

U = words.U
#: Up to so many lines (some 60 bytes each) are broadcast to fetch their texts; beyond, they are joined by a shuffle.
MAX_NEEDED = 200_000
#: Keys of a line: first and last part for its own length and for one less.
KEYS = 4
#: For two edits: parts of the sieve and of the keys that follow, and lines of a key that are compared pair by pair.
SIEVE_PARTS, PARTS = 3, (6, 24)
MAX_GROUP = 32


def _line_table(chunk: words.Chunk) -> tuple[np.ndarray, ...]:
    """(text, number in it, start, end) of the lines that have a word."""
    docs, starts, ends = chunk.lines()
    number = np.arange(len(docs)) - np.searchsorted(docs, docs)
    full = np.flatnonzero(np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts))
    return docs[full], number[full], starts[full], ends[full]


class _Points:
    """Code points of a chunk: where each begins, and running hashes over them."""

    def __init__(self, chunk: words.Chunk):
        self.begin = np.append(np.flatnonzero((chunk.data & 0xC0) != 0x80), len(chunk.data))
        raw = words._rolling(words._TABLE[chunk.data])
        # Each code point as one value, then running sums of values times powers.
        self.values = words._spans(raw, self.begin[:-1], self.begin[1:])
        self.acc = words._rolling(self.values)

    def parities(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each span, 32 bits of code points and 32 of adjacent pairs that are there an odd number of times."""
        one = self.values
        pair = words.mix(one[:-1] * U(0x9E3779B97F4A7C15) + one[1:])
        bits = lambda x, shift: U(1) << ((x & U(31)) + U(shift))
        run = lambda x: np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)])
        ones, pairs = run(bits(one, 32)), run(bits(pair, 0))
        return ones[ends] ^ ones[starts] ^ pairs[np.maximum(ends - 1, starts)] ^ pairs[starts]

    def at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places)

    def spans(self, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
        return words.mix(words._spans(self.acc, starts, ends) + U(salt))

    def without(self, start: int, end: int) -> np.ndarray:
        """Hashes of start:end, and of it without each one of its code points."""
        acc, n = self.acc, end - start
        base = acc[start]
        inv = words.powers(words._BASE_INV, end + 1)
        shift = inv[start]
        left = (acc[start:end] - base) * shift
        # What follows a dropped point moves one power down.
        right = (acc[end] - acc[start + 1 : end + 1]) * (shift * inv[1])
        whole = (acc[end] - base) * shift + U(n) * U(0xD6E8FEB86659FD93)
        less = left + right + U(n - 1) * U(0xD6E8FEB86659FD93)
        return words.mix(np.append(less, whole))


def _half_keys(points: _Points, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """A line of n points meets lines of n - 1, n and n + 1; the lesser length m of a pair sets the cut.

    For m both lines have their first m // 2 and last m - m // 2 points keyed,
    and m is part of the key.  One edit lies outside one of the two parts: at or
    after point m // 2 it leaves the first part as it was, before it the last.
    """
    n, out = last - first, []
    for m in (n, np.maximum(n - 1, 0)):
        cut = m // 2
        salt = m.astype(np.uint64) * U(0x9E3779B97F4A7C15)
        out.append(words.mix(points.spans(first, first + cut, 11) + salt).view(np.int64))
        out.append(words.mix(points.spans(last - (m - cut), last, 13) + salt).view(np.int64))
    return out


def _part_keys(points: _Points, first: np.ndarray, last: np.ndarray, parts: int) -> list[np.ndarray]:
    """Keys of lines cut into parts, of which two edits touch at most i and j.

    A line of m points meets lines of m to m + 2; it has its middle in place, they
    have it in place or one point later (both, where the lengths are equal).
    """
    n, out = last - first, []
    for less, shifts in ((0, (0, 1)), (1, (0, 1)), (2, (1,))):
        m = np.maximum(n - less, 0)
        cut = [m * i // parts for i in range(parts + 1)]
        salt = m.astype(np.uint64) * U(0x9E3779B97F4A7C15)
        heads = [words.mix(points.spans(first, first + cut[i], 17) + salt) for i in range(parts)]
        tails = [points.spans(last - (m - cut[i]), last, 19) for i in range(parts + 1)]
        for i in range(parts):
            for j in range(i + 1, parts):
                outer = words.mix(heads[i] + tails[j + 1])
                if j == i + 1:
                    out.append(outer.view(np.int64))
                else:
                    out += [words.mix(outer + points.spans(first + cut[i + 1] + s, first + cut[j] + s, 23)).view(np.int64) for s in shifts]
    return out


def _asked_bits(parts: int) -> np.ndarray:
    """For each key of _part_keys(), in its order, the bit of the pair of coarse parts (PARTS[0]) that holds the parts it leaves out.

    Lines that share a key share that of its pair too, as cuts of the coarse parts are cuts of the fine ones; parts
    inside one coarse part go with that part and the next (the last with the one before).
    """
    coarse, bits = PARTS[0], []
    number = {pair: n for n, pair in enumerate((i, j) for i in range(coarse) for j in range(i + 1, coarse))}
    for shifts in (2, 2, 1):
        for i in range(parts):
            for j in range(i + 1, parts):
                a, b = i * coarse // parts, j * coarse // parts
                if a == b:
                    a, b = (a, a + 1) if a + 1 < coarse else (a - 1, a)
                bits += [1 << number[a, b]] * (1 if j == i + 1 else shifts)
    return np.array(bits, np.int64)


def _n_keys(max_edits: int) -> int:
    """Sieve keys of a line."""
    return KEYS if max_edits < 2 else 11


def _scan(documents: DataFrame, id_col: str, text_col: str, max_edits: int = 1) -> DataFrame:
    """Every line with a word: where it is, its hash (a, b), code points and sieve keys; a row with line_no -1 for a text without any."""
    body = F.xxhash64(text_col)
    slim = documents.select(F.col(id_col).alias("id"), body.alias("body"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    n_keys = _n_keys(max_edits)
    names = ["id", "body", "row", "line_no", "a", "b", "chars", *(f"k{i}" for i in range(n_keys))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, columns = [], [[] for _ in range(4 + n_keys)]
        for chunk in words.chunks(batch.column(3)):
            docs, number, starts, ends = _line_table(chunk)
            points = _Points(chunk)
            first, last = points.at(starts), points.at(ends)
            values = [number, chunk.byte_spans(starts, ends).view(np.int64), points.spans(first, last, 3).view(np.int64), last - first, *(_half_keys(points, first, last) if max_edits < 2 else _part_keys(points, first, last, SIEVE_PARTS))]
            none = np.setdiff1d(np.arange(chunk.n), docs)
            which.append(chunk.first + np.concatenate([docs, none]))
            for column, x, fill in zip(columns, values, [-1, *[0] * (3 + n_keys)], strict=True):
                column.append(np.concatenate([x, np.full(len(none), fill, np.int64)]))
        rows = pa.array(np.concatenate(which) if which else np.zeros(0, np.int64))
        flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
        flat[0], flat[3] = flat[0].cast(pa.int32()), flat[3].cast(pa.int32())
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), *flat], names=names)

    kinds = dict(slim.dtypes)
    schema = f"id {kinds['id']}, body bigint, row bigint, line_no int, a bigint, b bigint, chars int, " + ", ".join(f"k{i} bigint" for i in range(n_keys))
    return map_batches(slim, run, schema)


def _texts_of(needed: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, ords, nos, and asked if that is given) of the documents that hold the lines `needed` (ord, first, and asked)."""
    more = [c for c in ("asked",) if c in needed.columns]
    lists = needed.groupBy("first.id", "first.body").agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "ord", *more)).alias("l"))
    lists = materialise(lists.select(F.col("id").alias("n_id"), F.col("body").alias("n_body"), F.col("l.ord").alias("ords"), F.col("l.line_no").alias("nos"), *(F.col(f"l.{c}").alias(c) for c in more)))
    lists = F.broadcast(lists) if needed.count() <= MAX_NEEDED else lists.hint("shuffle_hash")
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    return docs.join(lists, (F.col("body") == F.col("n_body")) & F.col("id").eqNullSafe(F.col("n_id"))).select("text", "ords", "nos", *more)


def _wanted(batch: pa.RecordBatch):
    """For each chunk of a _texts_of() batch: the chunk, and (ord, start, end) of the wanted lines."""
    ords, nos = batch.column(1), batch.column(2)
    values, numbers, cuts = ords.values.to_numpy(zero_copy_only=False), nos.values.to_numpy(zero_copy_only=False), ords.offsets.to_numpy()
    for chunk in words.chunks(batch.column(0)):
        docs, starts, ends = chunk.lines()
        edges = np.searchsorted(docs, np.arange(chunk.n))
        found = []
        for i in range(chunk.n):
            own = slice(cuts[chunk.first + i], cuts[chunk.first + i + 1])
            at = edges[i] + numbers[own]
            found += zip(values[own].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)
        yield chunk, found


def _neighbourhood(texts: DataFrame) -> DataFrame:
    """(v, place, ord): hashes of each line (place -1) and of it without the code point at place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, places, ords = [], [], []
        for chunk, found in _wanted(batch):
            points = _Points(chunk)
            for o, start, end in found:
                first, last = points.at(np.array([start, end]))
                keys.append(points.without(int(first), int(last)))
                places.append(np.append(np.arange(last - first), -1))
                ords.append(np.full(last - first + 1, o, np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, places, ords)]
        return pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2])], names=["v", "place", "ord"])

    return map_batches(texts, run, "v bigint, place int, ord bigint")


def _strings(texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(o, chunk.data[a:b].tobytes().decode("utf-8", "replace")) for chunk, lines in _wanted(batch) for o, a, b in lines]
        return pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["ord", "line"])

    return map_batches(texts, run, "ord bigint, line string")


def _keyed(texts: DataFrame, parts: int) -> DataFrame:
    """(key, ord, parity, asked): the distinct keys of each line, each with the bits of its pairs of coarse parts; only those with a bit that is asked of the line."""
    bits, chosen = _asked_bits(parts), "asked" in texts.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ords, parities, pairs = [], [], [], []
        asked_of = {}
        if chosen:
            asked_of = dict(zip(batch.column(1).flatten().to_pylist(), batch.column(3).flatten().to_pylist(), strict=True))
        for chunk, found in _wanted(batch):
            if not found:
                continue
            points = _Points(chunk)
            o, starts, ends = np.array(found, np.int64).T
            first, last = points.at(starts), points.at(ends)
            own = np.stack(_part_keys(points, first, last, parts), axis=1)
            order = np.argsort(own, axis=1, kind="stable")
            own, of_key = np.take_along_axis(own, order, axis=1), bits[order]
            new = np.ones(own.shape, bool)
            new[:, 1:] = own[:, 1:] != own[:, :-1]
            # A key that comes for several pairs has the bits of all.
            of_key = np.bitwise_or.reduceat(of_key.ravel(), np.flatnonzero(new.ravel()))
            rows = np.repeat(np.arange(len(o)), new.sum(axis=1))
            out = own[new]
            if chosen:
                kept = (of_key & np.array([asked_of[x] for x in o.tolist()], np.int64)[rows]) != 0
                out, of_key, rows = out[kept], of_key[kept], rows[kept]
            keys.append(out)
            ords.append(o[rows])
            parities.append(points.parities(first, last).view(np.int64)[rows])
            pairs.append(of_key)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, ords, parities, pairs)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["key", "ord", "parity", "asked"])

    return map_batches(texts, run, "key bigint, ord bigint, parity bigint, asked bigint")


def _with_group(rows: DataFrame, keys: list[str], *of_group: Column) -> DataFrame:
    """The rows with aggregates over their keys, which combine before their shuffle; the join on a hot key is left to adaptive splitting."""
    groups = rows.groupBy(*(F.col(k).alias(f"g_{k}") for k in keys)).agg(*of_group)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"g_{k}"))
    return rows.join(groups, same).drop(*(f"g_{k}" for k in keys))


def _near(x: Column, y: Column) -> Column:
    """Whether the parities of two lines allow two edits: an edit changes two code points' counts and four pairs' at most."""
    apart = x.bitwiseXOR(y)
    return (F.bit_count(F.shiftrightunsigned(apart, 32)) <= 4) & (F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) <= 8)


def _alike_by_two(going: DataFrame, documents: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(ord) of the lines `going` (ord, first) that have an alike line before them, for two edits."""
    texts = lambda ords: _texts_of(ords.join(going.select("ord", "first"), "ord"), documents, id_col, text_col)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        there = y.select(F.col("key").alias("k"), F.col("ord").alias("by"), F.col("parity").alias("other"))
        return x.select("key", "ord", "parity").join(there, (F.col("key") == F.col("k")) & (F.col("ord") > F.col("by")) & _near(F.col("parity"), F.col("other"))).select("ord", "by")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.distinct())
        strings = _strings(texts(pairs.select("ord").unionAll(pairs.select("by")).distinct())).groupBy("ord").agg(F.min("line").alias("line"))
        both = pairs.join(strings.withColumnRenamed("line", "x"), "ord").join(strings.select(F.col("ord").alias("by"), F.col("line").alias("y")), "by")
        edits = F.levenshtein("x", "y", 2)
        return materialise(both.where((edits >= 0) & (edits * min_chars <= F.least(F.length("x"), F.length("y")))).select("ord").distinct())

    out, open_lines = None, going.select("ord")
    for parts in PARTS:
        by_key = Window.partitionBy("key")
        # Keys that the same lines share are one key: a pair that is equal outside one part meets in every key with that part.
        members = F.expr("bit_xor(xxhash64(ord))").over(by_key)
        rows = _keyed(texts(open_lines), parts).withColumn("n", F.count("*").over(by_key)).withColumn("same", members).where("n > 1")
        rows = materialise(rows.groupBy(F.struct("same", "n").alias("key"), "ord").agg(F.first("parity").alias("parity"), F.first("n").alias("n"), F.bit_or("asked").alias("asked")))
        few, many = rows.where(F.col("n") <= MAX_GROUP), rows.where(F.col("n") > MAX_GROUP)
        found = verified(met(few, few))
        out = found if out is None else out.unionAll(found)
        # Of the finer keys a line needs those inside the pairs of parts that many share; pairs of lines in few are done.
        open_lines = many.groupBy("ord").agg(F.bit_or("asked").alias("asked"))
        if not many.limit(1).count():
            return out
    first = _with_group(many, ["key"], F.min(F.struct("ord", "parity")).alias("least"))
    found = verified(first.where(F.col("ord") > F.col("least.ord")).where(_near(F.col("parity"), F.col("least.parity"))).select("ord", F.col("least.ord").alias("by")))
    return out.unionAll(found).unionAll(verified(met(many.join(found, "ord", "left_anti"), many)))


def dropped_lines(documents: DataFrame, lines: DataFrame, id_col: str, text_col: str, min_chars: int, max_edits: int = 1) -> tuple[DataFrame, DataFrame]:
    """(distinct lines with their first occurrence, (a, b) of those that an earlier alike line replaces)."""
    place = F.struct(F.col("id").isNull().alias("z"), "id", "body", "row", "line_no")
    keys = [f"k{i}" for i in range(_n_keys(max_edits))]
    distinct = materialise(lines.where("line_no >= 0").groupBy("a", "b").agg(F.min(place).alias("first"), F.max("chars").alias("chars"), *(F.max(k).alias(k) for k in keys)))
    by_key = Window.partitionBy("key")
    shared = distinct.where(F.col("chars") >= min_chars).select("a", F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    shared = shared.withColumn("low", F.min("a").over(by_key)).withColumn("high", F.max("a").over(by_key)).where("low != high").select("a").distinct()
    # Numbers that rise with the order of first occurrences name the lines from here on.
    going = materialise(distinct.select("a", "b", "first").join(shared, "a", "left_semi").orderBy("first").withColumn("ord", F.monotonically_increasing_id()))
    if max_edits == 2:
        return distinct, _alike_by_two(going, documents, id_col, text_col, min_chars).distinct().join(going.select("ord", "a", "b"), "ord").select("a", "b")
    hoods = _neighbourhood(_texts_of(going.select("first", "ord"), documents, id_col, text_col))
    hoods = materialise(hoods.distinct())
    of_v = F.min("ord").alias("low"), F.max("ord").alias("high"), F.min(F.when(F.col("place") < 0, F.col("ord"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("ord"))).alias("longer")
    met = materialise(_with_group(hoods, ["v"], *of_v).where("low != high"))
    met = materialise(_with_group(met, ["v", "place"], F.min("ord").alias("peer")))
    pairs = met.where((F.col("place") >= 0) & (F.col("ord") > F.col("peer"))).select("ord", F.col("peer").alias("by"))
    pairs = pairs.unionAll(met.where((F.col("place") >= 0) & (F.col("ord") > F.col("whole"))).select("ord", "whole"))
    pairs = materialise(pairs.unionAll(met.where((F.col("place") < 0) & (F.col("ord") > F.col("longer"))).select("ord", "longer")).distinct())
    needed = pairs.select("ord").unionAll(pairs.select("by")).distinct().join(going.select("ord", "first"), "ord")
    strings = _strings(_texts_of(needed, documents, id_col, text_col)).groupBy("ord").agg(F.min("line").alias("line"))
    alike = pairs.join(strings.withColumnRenamed("line", "x"), "ord").join(strings.select(F.col("ord").alias("by"), F.col("line").alias("y")), "by").where(F.levenshtein("x", "y", 1) >= 0)
    return distinct, alike.select("ord").distinct().join(going.select("ord", "a", "b"), "ord").select("a", "b")


def dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 10) -> DataFrame:
    """One row per document row: the id, n_lines (with a word), n_kept, kept_lines (their numbers from 0) and body (hash of the text)."""
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits is 0, 1 or 2")
    lines = materialise(_scan(documents, id_col, text_col, max_edits))
    place = F.struct(F.col("id").isNull().alias("z"), "id", "body", "row", "line_no")
    if max_edits:
        distinct, dropped = dropped_lines(documents, lines, id_col, text_col, min_chars, max_edits)
        first = distinct.select("a", "b", "first").join(dropped, ["a", "b"], "left_anti").select("first")
    else:
        first = lines.where("line_no >= 0").groupBy("a", "b").agg(F.min(place).alias("first")).select("first")
    kept = first.groupBy(F.col("first.row").alias("k_row")).agg(F.sort_array(F.collect_list("first.line_no")).alias("kept_lines"))
    docs = lines.groupBy("row").agg(F.first("id").alias("id"), F.first("body").alias("body"), F.count_if(F.col("line_no") >= 0).alias("n_lines"))
    kept_lines = F.coalesce("kept_lines", F.array().cast("array<int>"))
    return docs.join(kept, F.col("row") == F.col("k_row"), "left").select(F.col("id").alias(id_col), "n_lines", F.size(kept_lines).cast("bigint").alias("n_kept"), kept_lines.alias("kept_lines"), "body")


def drop_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns, with only the kept lines and those without a word left in the text."""
    names = documents.columns
    key = id_col
    if repeated(documents, id_col, text_col):
        # Rows that id and text do not tell apart are numbered in order, and written so that the numbers stay.
        key = free_name(documents, "row")
        documents = materialise(documents.withColumn(key, F.struct(F.col(id_col), F.monotonically_increasing_id().alias("n"))))
    verdict = dedup(documents, id_col=key, text_col=text_col, **options).withColumnRenamed(key, "v_id")
    joined = documents.join(verdict, (F.xxhash64(documents[text_col]) == verdict["body"]) & documents[key].eqNullSafe(verdict["v_id"]))
    at = names.index(text_col)

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        kept = columns.pop()
        out = []
        for chunk in words.chunks(columns[at]):
            docs, starts, ends = chunk.lines()
            keep = np.searchsorted(chunk.starts, ends) <= np.searchsorted(chunk.starts, starts)
            edges = np.searchsorted(docs, np.arange(chunk.n + 1))
            for i in range(chunk.n):
                keep[edges[i] + kept[chunk.first + i].values.to_numpy(zero_copy_only=False)] = True
                rows = np.flatnonzero(keep[edges[i] : edges[i + 1]]) + edges[i]
                text = b"\n".join(chunk.data[starts[r] : ends[r]].tobytes() for r in rows).decode("utf-8", "replace")
                out.append(text if columns[at][chunk.first + i].is_valid else None)
        columns[at] = pa.array(out, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return map_batches(joined.select(*(documents[c] for c in names), verdict["kept_lines"].alias(free_name(documents, "kept_lines"))), strip, joined.select(*(documents[c] for c in names)).schema)
