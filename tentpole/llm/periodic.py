"""Periodic runs of words: a harmonic grid of longest-common-extension queries.

A run with period p that is at least two periods long beyond its first covers
two neighbours jp and (j+1)p of p's grid. How far the words from these two
places agree to the right and to the left gives the run's ends. Both extensions
are range minima over the common prefixes of sorted suffixes, of the words and
of the reversed words. All grids of a document have about n ln n places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 24, 3
#: Words of the documents whose suffixes are sorted together, and grid places that are looked at together.
WORDS, PLACES = 200_000, 1_000_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Suffixes:
    """The suffixes of a sequence of codes in order, for longest common extensions of many pairs at once."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.codes = codes
        order = np.argsort(codes, kind="stable")
        rank = np.empty(n, np.int64)
        new = np.flatnonzero(np.r_[True, codes[order[1:]] != codes[order[:-1]]])
        size = np.diff(np.r_[new, n])
        rank[order] = np.repeat(new, size)
        levels, width = [rank.astype(np.int32)], 1
        widest = int(size.max()) if n else 0
        # Suffixes that share their first `width` codes are told apart by the next `width`; those that stand alone are done.
        at = np.flatnonzero(np.repeat(size > 1, size))
        while len(at):
            who = order[at]
            beyond = who + width
            key = rank[who] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            order[at], key = who[by], key[by]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[new, len(at)])
            rank[order[at]] = np.repeat(at[new], size)
            levels.append(rank.astype(np.int32))
            at, width = at[np.repeat(size > 1, size)], 2 * width
        self.rank = rank
        # Common prefixes of neighbours in the order: the widest steps first. Ranks of a level agree exactly if so many codes do.
        lcp, a, b = np.zeros(n, np.int32), order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for x in (a, b):
                x[same] += 1 << k
            lcp[same + 1] += 1 << k
        # Minima over 1, 2, 4, ... neighbours, as far as suffixes with one first code reach.
        self.least = [lcp]
        while 1 << len(self.least) <= widest:
            x, step = self.least[-1], 1 << (len(self.least) - 1)
            y = x.copy()
            np.minimum(x[:-step], x[step:], out=y[:-step])
            self.least.append(y)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes agree from ``i[k]`` and ``j[k]`` on, for different places; 0 for places outside."""
        out, n = np.zeros(len(i), np.int64), len(self.codes)
        ok = np.flatnonzero((i >= 0) & (j >= 0) & (i < n) & (j < n))
        ok = ok[self.codes[i[ok]] == self.codes[j[ok]]]
        a, b = self.rank[i[ok]], self.rank[j[ok]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            x = self.least[k]
            out[ok[at]] = np.minimum(x[low[at]], x[high[at] - (1 << int(k)) + 1])
        return out


def grid(starts: np.ndarray, sizes: np.ndarray, times: int, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All grid neighbours of documents at ``starts`` with ``sizes`` words, in blocks: a number for each document and period, the left place, the period."""
    most = sizes // times
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = -(-sizes[doc] // period) - 1
    ends = np.cumsum(count)
    at = 0
    while at < len(doc):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + places, side="right")))
        c = count[at:upto]
        number = np.repeat(np.arange(at, upto), c)
        j = np.arange(len(number)) - np.repeat(np.cumsum(c) - c, c)
        yield number, starts[doc[number]] + j * period[number], period[number]
        at = upto


def runs_of(documents: list[list], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, smallest period) of each sequence of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(w) for w in documents], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes, base = [], 0
    for words in documents:  # no two documents have a code in common, so no extension leaves its document
        of = {w: base + k for k, w in enumerate(dict.fromkeys(words))}
        codes += map(of.__getitem__, words)
        base += len(of)
    codes = np.array(codes, np.int64)
    found = []
    for number, left, period in grid(starts, sizes, times):
        # Words that differ have nothing in common; a run of `times` periods, three or more, covers two grid neighbours in a row.
        same = codes[left] == codes[left + period]
        if times >= 3:
            next_to = same[:-1] & same[1:] & (number[:-1] == number[1:])
            same = np.r_[next_to, False] | np.r_[False, next_to]
        found.append((left[same], period[same]))
    left, period = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    if not len(left):
        return out
    # Only documents with such places need their suffixes sorted.
    used = np.unique(np.searchsorted(starts, left, side="right") - 1)
    within = np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in used])
    moved = np.cumsum(sizes[used]) - sizes[used]
    mine = np.searchsorted(starts[used], left, side="right") - 1
    left, own = left - starts[used][mine] + moved[mine], codes[within]
    there, back = Suffixes(own), Suffixes(own[::-1].copy())
    kept = set()
    for k in range(0, len(left), PLACES):
        a, p, m = left[k : k + PLACES], period[k : k + PLACES], mine[k : k + PLACES]
        right, before = there.common(a, a + p), back.common(len(own) - a, len(own) - a - p)
        length = before + right + p
        ok = (length >= times * p) & (length >= least)
        kept.update(zip((used[m])[ok].tolist(), (a - before - moved[m])[ok].tolist(), length[ok].tolist(), p[ok].tolist(), strict=True))
    seen = set()
    for d, start, length, p in sorted(kept):
        if (d, start, length) not in seen:  # multiples of the smallest period give the same stretch
            seen.add((d, start, length))
            out[d].append((start, length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def periodic_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All runs of every whole text's words, and the text without what the runs repeat: columns of ``SCHEMA``.

    A run is a stretch of at least ``least`` words and ``times`` (two or more)
    of its smallest period that no neighbouring word extends with that period.
    Words are runs of characters other than blank and \\x09-\\x0D. ``rewrite``
    may change a document's words first. A null or empty text has no words, no
    runs and an empty text; a null ``doc_id`` stays null; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows. One
    pass over the scan without a shuffle; in memory are some 200,000 words, or
    one document if it is longer.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least once: times must be 2 or more")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def out(ids: list, documents: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(documents, least, times)
        texts = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(documents, found, strict=True)], pa.binary()).cast(pa.string())
        runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], run_type)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, documents)), pa.int64()), runs, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, documents, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (t.as_py() or b"").split()
                ids.append(d)
                documents.append(rewrite(d, words) if rewrite else words)
                size += len(words)
                if size >= WORDS:
                    yield out(ids, documents)
                    ids, documents, size = [], [], 0
        if ids:
            yield out(ids, documents)

    return docs.mapInArrow(run, SCHEMA)
