"""Substring deduplication: Rabin-Karp hashes of every fixed-length window of words.

A window's key is the least Rabin-Karp hash of the short grams inside it, so
equal windows have equal keys. Runs of consecutive windows with one key are
counted first; only windows whose key occurs in two documents can repeat in
two, and only those go on to be counted, by key and their own hash: 128 bits
from two polynomials. That loses no repeat and keeps what is shuffled to a few
bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tentpole.llm.common import lookup_join, saved

WINDOW = 50
GRAM = 16
#: Odd multipliers of the two polynomial hashes modulo 2**64 (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: A key that at least so many runs have, or twenty times as many windows, is counted window by window, combined before the shuffle.
HEAVY_ROWS = 20_000
#: Of these keys, and of windows that often, at most so many, the most frequent, are joined by broadcast.
HEAVY_KEYS = 1000
#: Words that a worker remembers the hash of before it starts anew.
CACHE = 500_000


class WordHash(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


class Rolling:
    """Hashes of all windows of a sequence of word hashes by prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(max(n, 2 * len(getattr(self, name)), 4096), b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]

    def __call__(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hash of ``values[i : i + width]`` for every i: sum of values[i + j] * base ** j."""
        up, down = self.powers(len(values))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
        return (total[width:] - total[:-width]) * down[: len(values) - width + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of each 64-bit value, so that the least of some is any of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than blank and \\x09-\\x0D."""
    return text.split() if text else []


def key_runs(values: np.ndarray, roll: Rolling, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one key: (key, first window, number of windows)."""
    keys = sliding_min(mixed(roll(values, gram)), window - gram + 1)
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return keys[first], first, np.diff(np.append(first, len(keys)))


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, roll = WordHash(), Rolling(BASES[0])
        for b in batches:
            parts = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(t.as_py())
                if d is None or len(words) < window:
                    continue
                values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                k, f, n = key_runs(values, roll, window, gram)
                parts.append((k.view(np.int64), np.full(len(k), d, np.int64), f, n))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["key", "doc_id", "first", "n"])

    return run


def _hashed_runs(window: int):
    """The window hashes of a document's candidate runs: ``key``, ``doc_id``, ``first``, ``hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, roll = WordHash(), Rolling(BASES[1])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "doc_id", "first", "hashes", "hot"])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for b in batches:
            rows, size = [], 0
            for d, t, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words = words_of(t.as_py())
                if len(words) < window:
                    continue
                hashes = roll(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window)
                for key, f, n, hot in np.frombuffer(runs.as_py(), "<i8").reshape(-1, 4).tolist():
                    if part := hashes[f : f + n].tobytes():
                        rows.append((key, d, f, part, hot))
                        size += len(part)
                if size >= 4_000_000:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Window by window: key, document, position and hash of the runs in a batch."""
    blobs = b.column(3).combine_chunks() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3)
    n = np.array([len(x.as_buffer()) // 8 for x in blobs], np.int64)
    key, doc, first = (np.repeat(b.column(k).to_numpy(), n) for k in range(3))
    at = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) + first
    return key, doc, at, np.frombuffer(b"".join(x.as_py() for x in blobs), np.int64)


def _late(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Stretches of windows that also start in a document with a smaller id: document, first word, number of words."""
    key, doc, at, h = rows
    order = np.lexsort((doc, h, key))
    key, doc, at, h = (x[order] for x in rows)
    new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))
    late = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    doc, at = doc[late], at[late]
    if not len(doc):
        return [doc, at, at]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(doc)) - 1
    return [doc[start], at[start], at[end] - at[start]]


def _compared(window: int):
    """Compares runs, which come sorted by key, with the others of their key."""

    def out(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        doc, first, more = _late(rows)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(more + window)], names=["doc_id", "first", "n"]) if len(doc) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in (big.slice(k, 2000) for big in batches for k in range(0, big.num_rows, 2000)):
            flat = _flat(b)
            done = np.searchsorted(flat[0], flat[0][-1])  # the last key may go on in the next batch
            if done or held and held[-1][0][-1] != flat[0][-1]:
                rows = [np.concatenate(x) for x in zip(*held, tuple(x[:done] for x in flat), strict=True)]
                if len(rows[0]) and (made := out(rows)):
                    yield made
                held = []
            held.append(tuple(x[done:] for x in flat))
        if held and (made := out([np.concatenate(x) for x in zip(*held, strict=True)])):
            yield made

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _flat(b.slice(k, 2000))], names=["key", "doc_id", "at", "h"])


def _packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's list of structs of longs, sorted by the first field, as one binary value."""
    for b in batches:
        docs, blobs = [], []
        for d, runs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            docs.append(d)
            fields = np.stack([runs.values.field(k).to_numpy() for k in range(runs.values.type.num_fields)], 1)
            blobs.append(fields[np.argsort(fields[:, 0], kind="stable")].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "runs"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's spans, sorted by their first word, with those that overlap or touch made one."""
    for b in batches:
        docs, blobs = [], []
        for d, spans in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            first, n = (spans.values.field(k).to_numpy() for k in (0, 1))
            order = np.argsort(first, kind="stable")
            first, end = first[order], np.maximum.accumulate((first + n)[order])
            start = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
            last = np.append(start[1:], len(first)) - 1
            docs.append(d)
            blobs.append(np.stack([first[start], end[last] - first[start]], 1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "spans"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What to remove of each document that has repeats: ``doc_id`` and ``spans``.

    ``spans`` packs (first word, number of words) of the maximal intervals, in
    order, as little-endian 64-bit numbers. A word goes if a window of
    ``window`` words around it also starts in a document with a smaller id.
    Rows with a null id or text, or fewer words than a window, have none. Rows
    with one id count as one document, so repeated rows do not remove each
    other; should their texts differ, what is found in one holds, by position,
    in the others.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    runs = saved(rows.mapInArrow(_runs(window, gram), "key long, doc_id long, first long, n long"), "runs")
    ends = runs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("windows"))
    hot = (F.col("rows") >= HEAVY_ROWS) | (F.col("windows") >= 20 * HEAVY_ROWS)
    shared = saved(ends.where(F.col("lo") < F.col("hi")).select("key", "rows", hot.cast("long").alias("hot")), "keys")
    any_hot = not shared.where("hot = 1").isEmpty()
    heavy = [r[0] for r in shared.where(F.col("rows") >= HEAVY_ROWS).orderBy(F.desc("rows")).limit(HEAVY_KEYS).select("key").collect()] if any_hot else []
    ours = lookup_join(runs, shared.select("key", "hot"), "key", "inner", heavy)
    by_doc = ours.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "n", "hot")).alias("runs"))
    packed = by_doc.select("doc_id", "runs").mapInArrow(_packed_runs, "doc_id long, runs binary")
    hashed = rows.join(packed, "doc_id").select("doc_id", "text", "runs").mapInArrow(_hashed_runs(window), "key long, doc_id long, first long, hashes binary, hot long")
    if any_hot:
        hashed = saved(hashed, "hashed")
    light = hashed.where("hot = 0") if any_hot else hashed
    spans = light.drop("hot").repartition("key").sortWithinPartitions("key").mapInArrow(_compared(window), "doc_id long, first long, n long")
    if any_hot:
        spans = spans.unionByName(_heavy_spans(hashed.where("hot = 1").drop("hot"), window))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans")).select("doc_id", "spans").mapInArrow(_merged, "doc_id long, spans binary")


def _heavy_spans(hashed: DataFrame, window: int) -> DataFrame:
    """The spans of keys that too many runs have for one task: their windows are counted one by one, combined before the shuffle."""
    both = F.concat(F.lpad(F.hex("key"), 16, "0"), F.lpad(F.hex("h"), 16, "0"))  # 128 bits, as everywhere else
    found = hashed.mapInArrow(_exploded, "key long, doc_id long, at long, h long").select(F.unhex(both).alias("h"), "doc_id", "at")
    firsts = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("rows"))
    firsts = saved(firsts.where(F.col("lo") < F.col("hi")), "windows")
    heavy = [r[0] for r in firsts.where(F.col("rows") >= HEAVY_ROWS).orderBy(F.desc("rows")).limit(HEAVY_KEYS).select("h").collect()]
    late = lookup_join(found, firsts.select("h", "lo"), "h", "inner", heavy).where(F.col("doc_id") > F.col("lo"))
    return late.select("doc_id", F.col("at").alias("first"), F.lit(window).cast("long").alias("n"))


def _keep(words: list[bytes], spans: bytes | None) -> list[bytes]:
    if not spans:
        return words
    kept, at = [], 0
    for first, n in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
        kept += words[at:first]
        at = first + n
    return kept + words[at:]


def summary(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What the removal leaves of every document: word counts and the SHA-256 of the kept words.

    One row for each input row, null ids and texts included (nothing is removed
    from a row without an id); other columns are ignored; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest = [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                words = words_of(t.as_py())
                kept = _keep(words, s.as_py())
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.join(repeated_spans(docs, window, gram, doc_id, text), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, SCHEMA)


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, in their own columns, without their repeated spans.

    A text that loses words becomes the kept words joined by one blank (empty if
    none is left); any other text stays as it is, to the byte.
    """
    mark, columns = "__spans", docs.columns
    spans = repeated_spans(docs, window, gram, doc_id, text).withColumnsRenamed({"doc_id": "__of", "spans": mark})
    joined = docs.join(spans, F.col(doc_id) == F.col("__of"), "left").drop("__of")
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() if not (s := x.as_py()) else b" ".join(_keep(words_of(t.as_py().encode()), s)).decode() for t, x in zip(b.column(at), b.column(len(columns)), strict=True)]
            arrays = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.select(*columns, mark).mapInArrow(run, docs.schema)
