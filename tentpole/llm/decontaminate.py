"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

One scan of the corpus counts the words of the test items, which tells rare
n-grams; a second keeps the documents with an n-gram that may be a seed. These
are joined with the seeds by hash, seed hits of a document and an item give
windows of words, and each window meets its item for the alignment. Seeds,
items and hits stay tables; only filters of a fixed size are broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tentpole.llm.common import lookup_join, saved

WORDS = re.compile(r"[^\W_]+")
#: Words of a seed.
SEED = 3
#: A seed is rare if chance alone would give it at most so often in a million words of the corpus.
RARE = 0.05
#: Seeds that every item has at least; if fewer of its n-grams are rare, the rarest of the others are taken.
LEAST_SEEDS = 4
#: With these, a copy of which up to a third of the words are replaced still has half of the perfect score.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of a perfect copy from which a passage counts as one.
THRESHOLD = 0.5
#: Up to so many different words of the test items are broadcast, which spares work; with more, the filter of hashes does alone.
BLOCK_WORDS = 200_000
#: Bits of the filter of seed hashes for each seed, of which a seed sets two, and at most. A full filter only lets more through to the join.
BITS, MOST_BITS = 512, 1 << 27
#: Rows of a table up to which it is broadcast.
FEW = 200_000
SCHEMA = "doc_id long, item_id long, score double, first_word long, n_words long"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORDS.findall(text.lower()) if text else []


def seed_hash(words: list[str]) -> int:
    """A seed's 64-bit hash as a signed long."""
    h = xxh64_intdigest(" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def seeds_of(words: list[str], share: dict[str, float], n: int = SEED) -> list[tuple[int, int]]:
    """The seeds of an item as (offset, words), chosen by the words' shares of the corpus; none without words."""
    k = min(n, len(words))
    if not k:
        return []
    expected = [1e6 * math.prod(share.get(w, 0.0) for w in words[o : o + k]) for o in range(len(words) - k + 1)]
    order = sorted(range(len(expected)), key=lambda o: (expected[o], o))
    return [(o, k) for rank, o in enumerate(order) if rank < LEAST_SEEDS or expected[o] <= RARE]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-number arrays: (score, first in b, end in b).

    Row by row; gaps along a row come from a running maximum. The start is
    carried along with the score. Of equal scores the first end in ``b`` wins.
    """
    width = len(b)
    at = np.arange(width + 1)
    score, start = np.zeros(width + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for w in a:
        diagonal = score[:-1] + np.where(b == w, MATCH, MISMATCH)
        up = score + GAP
        now, begin = np.zeros(width + 1, np.int64), at.copy()
        take = diagonal > 0
        now[1:][take], begin[1:][take] = diagonal[take], start[:-1][take]
        take = up > now
        now[take], begin[take] = up[take], start[take]
        # A gap in the row: now[j] = max over i <= j of now[i] + GAP * (j - i).
        lifted = now - GAP * at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        now, begin = top + GAP * at, begin[source]
        score, start = now, begin
        j = int(np.argmax(score))
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


def spans_of(diagonals: list[int], item: int, document: int) -> list[tuple[int, int]]:
    """The parts (first word, end) of a document of so many words in which an item of so many, met at these offsets, may lie."""
    slack, spans = item // 2 + 2, []
    for d in sorted(diagonals):
        a, z = max(0, d - slack), min(document, d + item + slack)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], z)
        else:
            spans.append((a, z))
    return spans


def aligned(item: list[str], window: list[str], threshold: float = THRESHOLD) -> tuple[float, int, int] | None:
    """(share of the perfect score, first word, end) of the best alignment; None below the threshold."""
    counts, least = Counter(item), math.ceil(threshold * MATCH * len(item))
    # Every match scores MATCH at most, so too few words in common can't reach the threshold.
    if MATCH * sum((counts & Counter(w for w in window if w in counts)).values()) < least:
        return None
    number = {w: k for k, w in enumerate(counts)}
    score, first, end = smith_waterman(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in window]))
    return (score / (MATCH * len(item)), first, end) if score >= least else None


def _counted(vocabulary: frozenset[str] | None):
    """Words with their counts, of the vocabulary or all; the number of all words stands under the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        total = 0

        def out() -> pa.RecordBatch:
            rows = [*found.items(), (None, total)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                words = words_of(t.as_py())
                total += len(words)
                found.update(words if vocabulary is None else filter(vocabulary.__contains__, words))
                if len(found) > 400_000 and vocabulary is None:
                    yield out()
                    found.clear()
                    total = 0
        yield out()

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = words_of(t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array(words, pa.string())], names=["key", "at", "word"])


def _seeding(total: int):
    """The seeds of items, whose words come with their counts: hash, first word, words, item, offset and the item's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, each in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [x["word"] for x in each]
                share = {x["word"]: (x["n"] or 0) / total for x in each}
                rows += [(seed_hash(words[o : o + k]), words[o], k, key, o, len(words)) for o, k in seeds_of(words, share)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["h", "first", "k", "key", "at", "m"])

    return run


def _hits(bits: np.ndarray, first: frozenset[str] | None, lengths: list[int]):
    """The documents that may hold a seed: row, id, text, and where with which hash."""

    bits = bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, mask = TaskContext.get().partitionId() << 36, len(bits) * 8 - 1
        found: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("p", pa.int64()), ("h", pa.int64())]))], strict=True)], names=["row", "doc_id", "text", "hits"])
            found.clear()
            return made

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                words, hits = words_of(text), []
                for p in range(len(words)) if first is None else [p for p, w in enumerate(words) if w in first]:
                    for k in lengths:
                        if p + k <= len(words):
                            h = seed_hash(words[p : p + k])
                            g = h >> 32
                            if bits[(h & mask) >> 3] >> (h & 7) & 1 and bits[(g & mask) >> 3] >> (g & 7) & 1:
                                hits.append({"p": p, "h": h})
                if hits:
                    found.append((row, d, text, hits))
                    size += len(text) + 50 * len(hits)
                    if size > 4_000_000:
                        yield out()
                        size = 0
                row += 1
        if found:
            yield out()

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around the seeds of each item in a document."""
    for b in batches:
        for row, d, t, met in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            words = words_of(t.as_py())
            out = [(row, d, x["key"], a, " ".join(words[a:z])) for x in met for a, z in spans_of(x["diagonals"], x["m"], len(words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["row", "doc_id", "key", "a", "window"])


def _scored(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, d, key, a, window, item_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if found := aligned(words_of(text), window.split(), threshold):
                    out.append((row, d, key, item_id, found[0], a + found[1], found[2] - found[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2, strict=True)], names=["row", "doc_id", "key", "item_id", "score", "first_word", "n_words"])

    return run


def seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The seeds of all items (``key``, ``text``), rare by the words' shares of all documents (``text``)."""
    words = saved(items.select("key", "text").mapInArrow(_item_words, "key long, at long, word string"), "item-words")
    different = words.select("word").distinct().limit(BLOCK_WORDS + 1)
    held = frozenset(r["word"] for r in different.collect())
    counts = saved(docs.select("text").mapInArrow(_counted(None if len(held) > BLOCK_WORDS else held), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = max(1, counts.where("word is null").agg(F.sum("n")).first()[0] or 0)
    each = words.join(counts, "word", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "word", "n"))).alias("each"))
    return saved(each.select("key", "each").mapInArrow(_seeding(total), "h long, first string, k long, key long, at long, m long"), "seeds")


def _filter(found: DataFrame, n: int) -> np.ndarray:
    """Two bits for each hash of a seed, from its low and its high half, modulo a power of two, as bytes."""
    size = min(MOST_BITS, max(1 << 15, 1 << (BITS * max(1, n) - 1).bit_length()))
    halves = found.select(F.explode(F.array("h", F.shiftright("h", 32))).alias("h"))
    bit = F.pmod("h", F.lit(size)) + 1
    parts = halves.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.collect():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _found(rows: DataFrame, benchmark: DataFrame, threshold: float, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """A row for each document (``doc_id``, ``text``) and item that it holds, and the documents that may hold a seed (``row``, ``text``)."""
    sc = rows.sparkSession.sparkContext
    items = saved(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").withColumn("key", F.monotonically_increasing_id()), "items")
    found = seeds(rows, items)
    n = found.count()
    lengths = sorted(r["k"] for r in found.select("k").distinct().collect())
    firsts = frozenset(r["first"] for r in found.select("first").distinct().limit(BLOCK_WORDS + 1).collect())
    held = sc.broadcast((_filter(found, n), firsts if len(firsts) <= BLOCK_WORDS else None, lengths))
    near = saved(rows.select("doc_id", "text").mapInArrow(lambda batches: _hits(*held.value)(batches), "row long, doc_id long, text string, hits array<struct<p: long, h: long>>"), "near")
    hits = near.select("row", F.explode("hits").alias("x")).select("row", "x.*")
    table = found.select("h", "key", "at", "m")
    met = hits.join(F.broadcast(table) if n <= FEW else table, "h").groupBy("row", "key", "m").agg(F.collect_set(F.col("p") - F.col("at")).alias("diagonals"))
    met = met.groupBy("row").agg(F.collect_list(F.struct("key", "m", "diagonals")).alias("met"))
    windows = near.join(met, "row").select("row", "doc_id", "text", "met").mapInArrow(_windows, "row long, doc_id long, key long, a long, window string")
    texts = items.select("key", "item_id", F.col("text").alias("item"))
    small = (items.agg(F.sum(F.length("text") + 16)).first()[0] or 0) <= 8_000_000
    both = windows.join(F.broadcast(texts), "key") if small else lookup_join(saved(windows, "windows"), texts, "key", "inner")
    hit = both.select("row", "doc_id", "key", "a", "window", "item_id", "item").mapInArrow(_scored(threshold), "row long, doc_id long, key long, item_id long, score double, first_word long, n_words long")
    best = F.min_by(F.struct("score", "first_word", "n_words"), F.struct(-F.col("score"), "first_word"))
    return hit.groupBy("row", "key").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), best.alias("best")), near


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item that it holds a copy of, exact or edited.

    ``score`` is the alignment score as a share of a perfect copy's;
    ``first_word`` and ``n_words`` place the passage among the document's
    words. A copy is found if up to about a third of its words are replaced,
    or half of the item is there unchanged, and a seed is left whole.
    Documents are scanned where they lie; only those that may hold a seed are
    shuffled. Null or wordless texts match nothing; repeated documents or items
    give rows each; other columns are ignored; empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found, _ = _found(rows, benchmark, threshold, item_id, item_text)
    return found.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no test item.

    Whether one does depends on its text alone, so all rows of a text go or
    stay; null texts, wordless texts and all rows of an empty benchmark stay. The texts to go
    are told by 128 bits of hash, which are broadcast up to ``FEW`` of them.
    """
    key = lambda c: [F.xxhash64(c).alias("__a"), F.xxhash64(c, F.lit(1)).alias("__b")]
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found, near = _found(rows, benchmark, threshold, item_id, item_text)
    gone = saved(near.join(found.select("row").distinct(), "row", "left_semi").select(*key(F.col("text"))).distinct(), "leaks")
    marked = docs.select("*", *key(F.col(text).cast("string")))
    return marked.join(F.broadcast(gone) if gone.count() <= FEW else gone, ["__a", "__b"], "left_anti").select(*docs.columns)
