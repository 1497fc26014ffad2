"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE (a JSON file), B a BPE over pieces with byte fallback (a
model file) that adds a space in front; both encode space + text without special
tokens.  The tokens of both are intervals of bytes.  B's form a static interval
index, two sorted arrays of starts and ends; for each A token two bisections find
the B tokens that it overlaps.  A gap between B tokens that no A token spans is a
place where tokens of both end: it cuts the tokens into groups.  All A-B pairs
of token occurrences inside a group are linked.

1. Texts are cut into units at each space that follows a character other than
   white space.  Neither tokenizer has a token across such a place (checked
   against the vocabularies; where it fails, a whole text is one unit), so equal
   units align equally wherever they stand.  Each is encoded and aligned once per
   task, as long as it is among the MAX_UNITS kept; documents are then sums over
   their units.
2. A block of about BLOCK_CHARS code points of whole texts becomes one row: the
   counts and digests of its documents, their units, the links of each unit, and
   in how many of its documents each pair of ids is linked.
3. The blocks' counts are added up by pair, which combines before the shuffle; a
   window over each A id, at most as many rows as B has ids, marks its greatest.
4. The counts return to the blocks by a join on the pair (a pair comes once a
   block, however often its documents hold it), and each block gives its rows.

Cases: a text that is null or empty, or whose tokens' bytes do not join to space
+ text (say one with U+2581), has no tokens and counts for nothing; repeated rows
and equal or null ids are documents of their own; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import give_back, map_arrow, materialise
from loomgraph.llm.token_counts import PATTERN

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of text that make a block; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: Units, and code points of them, that a worker keeps from block to block.
MAX_UNITS, MAX_UNIT_CHARS = 60_000, 2_000_000
#: Characters that an engine of patterns might take for white space, besides those of Python's.
_DOUBTFUL = "᠎​﻿"
_CUT = re.compile(f"(?<=[^\\s{_DOUBTFUL}]) ")
_NO_CUT = re.compile(f"[\\s{_DOUBTFUL}] ")


def _byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of each unit, and the bytes of each id.

    The file's vocabulary is encoded by ranks, which takes a tenth of the time of
    its own library and gives the same ids, as its merges rank by the ids they
    give (checked) under the pattern that its kind of file stands for.
    """

    def __init__(self, definition: bytes):
        made = json.loads(definition)
        kind = made.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or made.get("normalizer"):
            raise ValueError("a byte-level tokenizer with its pattern, without normalizer and added space is needed")
        letters, ids = _byte_of_letter(), made["model"]["vocab"]
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in made["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges must rank by the ids that they give")
        self.token = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            self.token[i] = bytes(letters[c] for c in text)
        self.encoder = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.token) if t}, special_tokens={})
        # The pattern keeps a space apart from what precedes it, but for white space.
        self.splits = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.encoder.encode_ordinary, texts))


class Pieces:
    """Tokenizer B, which puts a space in front by itself."""

    def __init__(self, model: bytes):
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.encoder.vocab_size()
        piece = [self.encoder.id_to_piece(i) for i in range(n)]
        self.token = [bytes([int(p[3:-1], 16)]) if self.encoder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.space = [self.encoder.piece_to_id("▁")]
        self.splits = not any("▁" in p.lstrip("▁") for p in piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, given without the first space."""
        return [ids or self.space for ids in self.encoder.encode(texts, num_threads=1)]


def stab(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A token and of each B token, where both cover the same bytes; ends rise."""
    if not len(b_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left") - 1
    n = len(b_ends)
    # A token over B tokens first..last spans the gaps behind first..last-1.
    spanned = np.cumsum(np.bincount(first, minlength=n) - np.bincount(last, minlength=n))
    group = np.cumsum(np.append(0, spanned[:-1] == 0))
    return group[first], group


def _cuts(sizes) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - _cuts(sizes)[:-1], sizes) + np.arange(sizes.sum())


def _distinct(x: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The distinct values in order, and where each value of x stands in them."""
    values = np.sort(x)
    if len(values):
        values = values[np.append(True, values[1:] != values[:-1])]
    return values, np.searchsorted(values, x) if places else None


class Units:
    """Units that were aligned, by number: whether their bytes agree, counts, groups as text, linked pairs (A id * 2**32 + B id)."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.whole = not (a.splits and b.splits)
        self.a_size, self.b_size = (np.array([len(t) for t in x.token]) for x in (a, b))
        self.number: dict[str, int] = {}
        self.chars = 0
        self.text: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # agree, A tokens, B tokens, groups, links
        self.pairs = np.zeros(0, np.int64)
        self.pair_cuts = np.zeros(1, np.int64)
        self.blocks = np.zeros(0, np.int64)  # blocks that had the unit

    def forget(self, everything: bool = False) -> None:
        """If there are too many units, keep at most half as many: those that most blocks had."""
        if not everything and len(self.text) <= MAX_UNITS and self.chars <= MAX_UNIT_CHARS:
            return
        names = list(self.number)
        kept = np.argsort(-self.blocks, kind="stable")[: 0 if everything else MAX_UNITS // 2]
        kept = kept[self.blocks[kept] > 1]
        sizes = np.cumsum([len(names[i]) for i in kept.tolist()])
        kept = np.sort(kept[: int(np.searchsorted(sizes, MAX_UNIT_CHARS // 2))])
        links = self.counts[kept, 4]
        self.pairs = self.pairs[_ranges(self.pair_cuts[kept], links)]
        self.number = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.text = [self.text[i] for i in kept.tolist()]
        self.counts, self.pair_cuts, self.blocks = self.counts[kept], _cuts(links), (self.blocks[kept] + 1) // 2
        self.chars = sum(map(len, self.number))

    def _agree(self, units: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both join to space + unit: of all units at once, and one by one where they do not."""
        joined = [(" " + u).encode("utf-8", "replace") for u in units]
        size = np.array([len(x) for x in joined])
        same = np.ones(len(units), bool)
        for ids, of, sizes in ((a_ids, self.a.token, self.a_size), (b_ids, self.b.token, self.b_size)):
            flat = list(chain.from_iterable(ids))
            ends = np.append(0, np.cumsum(sizes[flat]))[_cuts([len(x) for x in ids])]
            if not (np.array_equal(np.diff(ends), size) and b"".join(map(of.__getitem__, flat)) == b"".join(joined)):
                same &= np.fromiter((b"".join([of[t] for t in x]) == y for x, y in zip(ids, joined, strict=True)), bool, len(units))
        return same

    def learn(self, units: list[str]) -> None:
        """Encode and align new units."""
        self.number.update(zip(units, range(len(self.text), len(self.text) + len(units)), strict=True))
        self.chars += sum(map(len, units))
        a_ids, b_ids = self.a.encode([" " + u for u in units]), self.b.encode(units)
        agree = self._agree(units, a_ids, b_ids)
        at = np.flatnonzero(agree)
        a_ids, b_ids = ([x[i] for i in at.tolist()] for x in (a_ids, b_ids))
        a_n, b_n = (np.array(list(map(len, x)), np.int64) for x in (a_ids, b_ids))
        a_flat, b_flat = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, a_n), (b_ids, b_n)))
        a_group, b_group = stab(np.cumsum(self.a_size[a_flat]), np.cumsum(self.b_size[b_flat]))
        n_groups = int(b_group[-1]) + 1 if len(b_group) else 0
        a_in, b_in = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        # Links: every A token with all B tokens of its group.
        each = b_in[a_group]
        pairs = (np.repeat(a_flat, each) << 32) + b_flat[_ranges(_cuts(b_in)[:-1][a_group], each)]
        of_group = np.repeat(np.arange(len(at)), b_n)[_cuts(b_in)[:-1]] if n_groups else np.zeros(0, np.int64)
        counts = np.zeros((len(units), 5), np.int64)
        counts[at] = np.stack([np.ones(len(at), np.int64), a_n, b_n, np.bincount(of_group, minlength=len(at)), np.bincount(of_group, a_in * b_in, len(at)).astype(np.int64)], axis=1)
        joined = lambda cuts, values, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values), by)
        groups = pc.binary_join_element_wise(joined(_cuts(a_in), pa.array(a_flat).cast(pa.string()), ","), joined(_cuts(b_in), pa.array(b_flat).cast(pa.string()), ","), "|")
        self.text += joined(_cuts(counts[:, 3]), groups, ";").to_pylist()
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.pair_cuts = np.concatenate([self.pair_cuts, self.pair_cuts[-1] + np.cumsum(counts[:, 4])])
        self.blocks = np.append(self.blocks, np.zeros(len(units), np.int64))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units of all texts, how many each text has)."""
        odd = np.array([self.whole or t[:1] == " " or _NO_CUT.search(t) is not None for t in texts], bool)
        cut = pc.split_pattern(pa.array([t for t, o in zip(texts, odd, strict=True) if not o], pa.large_string()), " ")
        rest = [[t] if self.whole else _CUT.split(t) for t, o in zip(texts, odd, strict=True) if o]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd], sizes[odd] = np.diff(cut.offsets.to_numpy()), list(map(len, rest))
        coded = pa.concat_arrays([cut.flatten(), pa.array(chain.from_iterable(rest), pa.large_string())]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        new = [u for u in units if u not in self.number]
        if new:
            self.learn(new)
        flat = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))[coded.indices.to_numpy()]
        # The odd texts' units stand behind the others'.
        starts = np.zeros(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        starts[order] = _cuts(sizes[order])[:-1]
        return flat[_ranges(starts, sizes)], sizes


#: Columns of a block beside its ids: of documents, of units, of pairs.
_DOCS = "n_a n_b n_groups n_links".split()
_BLOCK = ", ".join([*(f"{c} array<bigint>" for c in _DOCS), "digest array<string>", "pair array<bigint>", "docs_in array<int>"])
#: Numbers that only the block itself reads again: units of each document, units, links of each unit, links; packed as one compressed value.
_PACKED = ("n_units", "unit", "unit_links", "link")


def _pack(numbers: dict[str, np.ndarray]) -> dict:
    flat = np.concatenate([numbers[c].astype(np.int32) for c in _PACKED])
    return {"packed": pa.compress(flat.tobytes(), codec="zstd", asbytes=True), "sizes": [len(numbers[c]) for c in _PACKED]}


def _unpack(packed: bytes, sizes: list[int]) -> dict[str, np.ndarray]:
    flat = np.frombuffer(pa.decompress(packed, decompressed_size=4 * sum(sizes), codec="zstd", asbytes=True), np.int32)
    return dict(zip(_PACKED, np.split(flat.astype(np.int64), np.cumsum(sizes)[:-1]), strict=True))


def _block(units: Units, texts: list[str | None]) -> dict[str, list]:
    """What a block's row holds."""
    units.forget()
    full = np.array([i for i, t in enumerate(texts) if t], np.int64)
    used, sizes = units.of([texts[i] for i in full])
    cuts = _cuts(sizes)
    agree = np.logical_and.reduceat(units.counts[used, 0] > 0, cuts[:-1]) if len(full) else np.zeros(0, bool)
    sums = np.add.reduceat(units.counts[used, 1:], cuts[:-1], axis=0)[agree] if len(full) else np.zeros((0, 4), np.int64)
    used, sizes, full = used[np.repeat(agree, sizes)], sizes[agree], full[agree]
    cuts = _cuts(sizes)
    out = np.zeros((len(texts), 4), np.int64)
    out[full] = sums
    digest, n_units = [""] * len(texts), np.zeros(len(texts), np.int32)
    n_units[full] = sizes
    own, unit = _distinct(used)
    groups = pa.array([units.text[u] for u in own.tolist()], pa.string()).take(pa.array(unit))
    for i, text in zip(full.tolist(), pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), groups), ";"), strict=True):
        digest[i] = hashlib.sha256(text.as_buffer()).hexdigest()
    units.blocks[own] += 1
    links = units.counts[own, 4]
    pair, link = _distinct(units.pairs[_ranges(units.pair_cuts[own], links)])
    # A document counts once for a pair: its distinct units' pairs, then distinct (document, pair).
    held, _ = _distinct(np.repeat(np.arange(len(full)), sizes) * max(len(own), 1) + unit, False)
    doc, u = held // max(len(own), 1), held % max(len(own), 1)
    held, _ = _distinct(np.repeat(doc, links[u]) * max(len(pair), 1) + link[_ranges(_cuts(links)[:-1][u], links[u])], False)
    docs_in = np.bincount(held % max(len(pair), 1), minlength=len(pair))
    return dict(zip(_DOCS, out.T, strict=True)) | {"digest": digest, "pair": pair, "docs_in": docs_in} | _pack({"n_units": n_units, "unit": unit, "unit_links": links, "link": link})


_workers: dict[int, tuple[ByteLevel, Pieces]] = {}


def _tokenizers(byte_bpe: bytes, piece_bpe: bytes) -> tuple[ByteLevel, Pieces]:
    """A Python worker makes its tokenizers once."""
    key = hash((byte_bpe, piece_bpe))
    if key not in _workers:
        _workers[key] = ByteLevel(byte_bpe), Pieces(piece_bpe)
    return _workers[key]


def _blocks(documents: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_bpe: str) -> DataFrame:
    spark = documents.sparkSession
    files = []
    for path in (byte_bpe, piece_bpe):
        with open(path, "rb") as file:
            files.append(spark.sparkContext.broadcast(file.read()))
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = [(name, pa.list_({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind[6:-1]])) for name, kind in (c.split(" ") for c in _BLOCK.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(*_tokenizers(files[0].value, files[1].value))
        for batch in batches:
            ids, column, start = batch.column(0), batch.column(1), 0
            chars = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while start < batch.num_rows:
                before = int(chars[start - 1]) if start else 0
                end = min(int(np.searchsorted(chars, before + BLOCK_CHARS)) + 1, batch.num_rows)
                row = _block(units, column.slice(start, end - start).to_pylist())
                own = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), ids.slice(start, end - start))
                flat = [pa.ListArray.from_arrays(pa.array([0, len(row[n])], pa.int32()), pa.array(row[n], kind.value_type)) for n, kind in lists]
                yield pa.RecordBatch.from_arrays([own, *flat, pa.array([row["packed"]], pa.binary()), pa.array([row["sizes"]], pa.list_(pa.int32()))], names=["ids", *(n for n, _ in lists), "packed", "sizes"])
                start = end
        units.forget(everything=True)
        give_back()

    return map_arrow(slim, run, f"ids array<{dict(slim.dtypes)['id']}>, {_BLOCK}, packed binary, sizes array<int>")


def _of_blocks(batch: pa.RecordBatch, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of each block, whose pairs have their counts (n, best) in order."""
    column = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        part = lambda name, i=i: column[name].slice(i, 1).flatten()
        scores, own, out = part("scores"), _unpack(column["packed"][i].as_py(), column["sizes"][i].as_py()), []
        for name in ("best", "n"):
            score = scores.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
            of_unit = np.diff(np.append(0, np.cumsum(score[own["link"]]))[_cuts(own["unit_links"])])
            out.append(np.diff(np.append(0, np.cumsum(of_unit[own["unit"]]))[_cuts(own["n_units"])]))
        ids = part("ids")
        yield pa.RecordBatch.from_arrays([ids.cast(id_type), *(part(n) for n in _DOCS), *(pa.array(x) for x in out), part("digest")], names=["id", *_DOCS, "n_best", "count_sum", "groups_sha256"])


def align(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row per document row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (of `a1,a2|b1;...`, '' without tokens).

    n_best counts the links whose pair is linked in as many documents as any pair
    of its A id, count_sum adds up the documents that hold each link's pair.
    """
    blocks = materialise(_blocks(documents, id_col, text_col, byte_bpe, piece_bpe).withColumn("block", F.monotonically_increasing_id()))
    counts = pair_counts(blocks)
    held = blocks.select("block", F.posexplode("pair").alias("pos", "pair"))
    scores = held.join(counts.select("pair", "n", "best"), "pair").groupBy(F.col("block").alias("s_block")).agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("scores"))
    none = F.array().cast("array<struct<pos: int, n: bigint, best: boolean>>")
    joined = blocks.join(scores, F.col("block") == F.col("s_block"), "left").select("ids", *_DOCS, "digest", "packed", "sizes", F.coalesce("scores", none).alias("scores"))
    id_kind = dict(blocks.dtypes)["ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _of_blocks(batch, batch.schema.field("ids").type.value_type)

    out = map_arrow(joined, run, f"id {id_kind}, " + ", ".join(f"{c} bigint" for c in (*_DOCS, "n_best", "count_sum")) + ", groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best): in how many documents each pair of ids is linked, and whether that is the most of its A id."""
    each = blocks.select(F.explode(F.arrays_zip("pair", "docs_in")).alias("p"))
    counts = each.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.docs_in").alias("n"))
    counts = counts.withColumn("a_id", F.shiftright("pair", 32).cast("int")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a_id")))
