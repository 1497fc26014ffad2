"""Vectorised word, line and shingle hashing over Arrow string columns.

Everything here is plain numpy over the UTF-8 bytes of a batch of texts: no
per-word Python objects are made.  A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; texts that are null have no words.

Hashes are 64-bit polynomial hashes of bytes mapped through a fixed random
table, finished with the splitmix64 mixer, so equal strings always collide and
different strings collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE_LOWER = _TABLE[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept and grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * U(pow(base, len(have), 2**64))])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _rolling(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def _spans(acc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of values[start:end] for each span of a _rolling sum."""
    inv = powers(_BASE_INV, len(acc))
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


class Chunk:
    """Words of a run of texts, as positions in their joined bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        space = _SPACE[data]
        begin, end = ~space, ~space
        if len(data):
            begin[1:] &= space[:-1]
            end[:-1] &= space[1:]
            cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
            begin[cuts] = ~space[cuts]
            end[cuts[1:] - 1] = ~space[cuts[1:] - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        #: words of text i are cuts[i]:cuts[i+1]
        self.cuts = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.cuts)
        self._acc: dict[bool, np.ndarray] = {}

    def acc(self, lower: bool) -> np.ndarray:
        if lower not in self._acc:
            self._acc[lower] = _rolling((_TABLE_LOWER if lower else _TABLE)[self.data])
        return self._acc[lower]

    def word_hashes(self, lower: bool) -> np.ndarray:
        return _spans(self.acc(lower), self.starts, self.ends)

    def byte_spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        return _spans(self.acc(lower), starts, ends)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every window of k words inside one text."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        docs = self.doc_of_words()
        at = np.flatnonzero(docs[:n] == docs[k - 1 :])
        total = np.full(len(at), U(k))
        for j in range(k):
            total = total * U(_BASE) + hashes[at + j]
        return at, mix(total)

    def shingles(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cuts, values): distinct sorted shingles of text i are values[cuts[i]:cuts[i+1]].

        A text of 1 to k-1 words has its whole word sequence as one shingle;
        one without words has none.
        """
        at, values = self.windows(hashes, k)
        where = np.searchsorted(at, self.cuts)
        out, sizes = [], np.zeros(self.n, np.int64)
        for i in range(self.n):
            n = self.counts[i]
            if n >= k:
                one = values[where[i] : where[i + 1]].copy()
                one.sort()
                if len(one) > 1:
                    one = one[np.concatenate([[True], one[1:] != one[:-1]])]
            elif n:
                total = U(n)
                with np.errstate(over="ignore"):
                    for h in hashes[self.cuts[i] : self.cuts[i + 1]]:
                        total = total * U(_BASE) + h
                one = mix(np.array([total], np.uint64))
            else:
                continue
            sizes[i] = len(one)
            out.append(one)
        cuts = np.zeros(self.n + 1, np.int64)
        np.cumsum(sizes, out=cuts[1:])
        return cuts, np.concatenate(out) if out else np.zeros(0, np.uint64)

    @staticmethod
    def _by_text(texts: np.ndarray, places: np.ndarray) -> np.ndarray:
        return places[np.lexsort((places, texts))]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, start byte, end byte) of every \\n-split line, empty texts without one."""
        full = np.flatnonzero(self.offsets[:-1] < self.offsets[1:])
        breaks = np.flatnonzero(self.data == 0x0A)
        inside = np.searchsorted(self.offsets[full + 1], breaks, side="right")
        each = np.arange(len(full))
        starts = self._by_text(np.concatenate([each, inside]), np.concatenate([self.offsets[full], breaks + 1]))
        ends = self._by_text(np.concatenate([inside, each]), np.concatenate([breaks, self.offsets[full + 1]]))
        docs = full[np.sort(np.concatenate([each, inside]))]
        return docs, starts, ends


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points: out[b] - out[a] is that of bytes a:b."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
