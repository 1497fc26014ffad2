"""Periodic runs of words: stretches that repeat a smallest period several times.

A run is a stretch of consecutive words whose words a period q apart are equal, q
being its smallest period, that is at least `min_words` words and `repeats` times
q long and that no neighbouring word extends with period q.

1. Texts become arrays of word hashes.  A run's words equal those q further on
   over all but its last q words, so a text in which no stretch of as many words
   comes twice has no run and goes no further; equality of hashes loses none.
2. The other texts of a batch are laid into one array, parted by values of their
   own.  Suffix arrays of it and of the reversed array (by doubling) give the
   longest common prefixes of neighbours, and tables of minima over spans of
   2**j of them (RMQ) answer in two look-ups how far the words from two places on
   are equal (LCE), or those before them.
3. Harmonic grid: for each period p the places jp and (j + 1)p, of which only
   every second has to be asked for three repeats (a run holds two of them), some
   n log n pairs a text.  Pairs of equal words are asked forward and backward,
   which gives the maximal stretch with period p around them.  Stretches that
   come again with a multiple of their period keep the smallest.

Everything of a text is done in one task, as its runs depend on nothing else;
there is no shuffle.  Memory follows the longest text (some 200 bytes a word);
pairs of the grid are made MAX_PAIRS at a time.

Cases: null or empty texts have no words and no runs, and '' as collapsed text;
ids are not looked at, so null and equal ids and repeated rows are rows like any
other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import words
from loomgraph.llm.common import map_batches

#: Words that are laid into one array, and pairs of the grid that are asked at a time.
MAX_WORDS, MAX_PAIRS = 16_384, 1 << 20


class _Extension:
    """LCE of an array whose last value comes once: how many values from places a and b on are equal."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        rank = np.searchsorted(np.unique(values), values)
        levels, width = [rank.astype(np.int32)], 1
        while rank.max() < n - 1:  # ranks of all stretches of `width` values, doubled until they differ
            key = rank * (n + 1)
            key[:-width] += rank[width:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
            levels.append(rank.astype(np.int32))
            width *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        a, b, common = suffixes[:-1], suffixes[1:], np.zeros(n - 1, np.int64)
        for level in range(len(levels) - 2, -1, -1):
            same = levels[level][a + common] == levels[level][b + common]
            common[same] += 1 << level
        self.rank, self.least = rank, [common.astype(np.int32)]
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            w = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-w], self.least[-1][w:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low), np.int64)
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            out[at] = np.minimum(self.least[j][low[at]], self.least[j][high[at] - (1 << j)])
        return out


def _grid(sizes: np.ndarray, min_words: int, repeats: int):
    """(text, x, p) of the pairs of places x and x + p, MAX_PAIRS or one period at a time."""
    most = np.where(sizes >= min_words, sizes // repeats, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    p = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # Over so many places at least a run's words equal those p further on; a grid that wide meets it.
    step = p * np.maximum((np.maximum(min_words, repeats * p) - p) // p, 1)
    n = -((p - sizes[text]) // step)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MAX_PAIRS, side="right")))
        own = slice(start, end)
        each = np.repeat(np.arange(start, end), n[own])
        j = np.arange(len(each)) - np.repeat(ends[own] - n[own] - (ends[start] - n[start]), n[own])
        yield text[each], j * step[each], p[each]
        start = end


def find(texts: list[np.ndarray], min_words: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of texts of word hashes, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes
    flat = np.concatenate([np.zeros(1, np.uint64), *(np.append(t, np.uint64(0)) for t in texts)])
    values = np.searchsorted(np.unique(flat), flat) + len(texts) + 1
    values[np.append(0, first + sizes)] = np.arange(len(texts) + 1)  # each comes once
    after, before, last = _Extension(values), _Extension(values[::-1].copy()), len(values)
    found = []
    for text, x, p in _grid(sizes, min_words, repeats):
        x = first[text] + x
        at = np.flatnonzero(values[x] == values[x + p])
        text, x, p = text[at], x[at], p[at]
        back = before(last - x, last - x - p)
        length = back + after(x, x + p) + p
        long = length >= np.maximum(min_words, repeats * p)
        found.append(np.stack([text, x - back - first[text], length, p])[:, long])
    text, start, length, p = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    order = np.lexsort((p, length, start, text))
    text, start, length, p = text[order], start[order], length[order], p[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    order = np.flatnonzero(new)[np.lexsort((p[new], start[new], text[new]))]
    return text[order], start[order], length[order], p[order]


def _repeating(chunk: words.Chunk, hashes: np.ndarray, k: int) -> np.ndarray:
    """The texts of a chunk in which some stretch of k words comes twice."""
    at, windows = chunk.windows(hashes, k)
    of = np.searchsorted(chunk.cuts, at, side="right") - 1
    key = words.mix(windows + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return np.unique(of[order[same]])


def periodic_runs(documents: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 24, repeats: int = 3) -> DataFrame:
    """The columns `keep` of each row, n_words, runs (of start, length, period, in order) and collapsed.

    collapsed are the words that are in no run, or only among its first period,
    joined by one space.
    """
    if repeats < 2 or min_words < repeats:
        raise ValueError("a run repeats its period twice at least, in at least as many words")
    slim = documents.select(*keep, F.col(text_col))
    at, kinds = len(keep), dict(slim.dtypes)
    k = min(max(min_words, repeats * p) - p for p in range(1, min_words + 1))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, collapsed, open_texts, runs = [], [], [], []

        def close() -> None:
            numbers = np.array([i for i, _ in open_texts], np.int64)
            text, *rest = find([t for _, t in open_texts], min_words, repeats)
            runs.append(np.stack([numbers[text], *rest]))
            open_texts.clear()

        size = 0
        for chunk in words.chunks(batch.column(at)):
            n_words.append(chunk.counts)
            hashes = chunk.word_hashes(lower=False)
            for i in _repeating(chunk, hashes, k).tolist():
                open_texts.append((chunk.first + i, hashes[chunk.cuts[i] : chunk.cuts[i + 1]]))
                size += int(chunk.counts[i])
                if size >= MAX_WORDS:
                    close()
                    size = 0
        if open_texts:
            close()
        text, start, length, period = np.concatenate(runs, axis=1) if runs else np.zeros((4, 0), np.int64)
        n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
        for i, value in enumerate(batch.column(at)):
            found = value.as_buffer().to_pybytes().split() if value.is_valid else []
            own = slice(cuts[i], cuts[i + 1])
            if cuts[i] < cuts[i + 1]:
                n = len(found) + 1
                inside = np.bincount(start[own] + period[own], minlength=n) - np.bincount(start[own] + length[own], minlength=n)
                found = [found[j] for j in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist()]
            collapsed.append(b" ".join(found))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n_words), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*keep, "n_words", "runs", "collapsed"])

    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return map_batches(slim, scan, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words bigint", f"runs {run}", "collapsed string"]))
