"""SimHash near-duplicates found by covering the space of fingerprints with anchor points.

Anchors are the words of the perfect binary Golay code of length 23: every
23-bit point lies within distance 3 of exactly one of them. A fingerprint is
cut into segments (padded with zero bits to 23). Where two of them differ by at
most ``slack`` bits in some segment, the nearest anchor of the one lies within
``3 + slack`` of the other there. So each fingerprint is at home at its nearest
anchor, is replicated to all anchors within ``3 + slack``, and is compared at
each anchor with those at home there. With few bits between linked ones
(``FOUR_BITS``) some segment always differs that little, so none is missed;
with many (``SIMILAR``) nearly always: each of twelve segments is a chance.

Where a scheme asks for a similarity, these links are candidates only: texts of
a group of candidates are compared by their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tentpole.llm.common import connected_components, lookup_join, saved
from tentpole.llm.substring import mixed

#: Generator polynomial, length, dimension and covering radius of the code (fixed values).
GENERATOR, LENGTH, DIMENSION, RADIUS = 0xC75, 23, 12, 3
SEED = 42
#: An anchor with more homes or replicas than this is cut into a grid of cells of at most that many each.
CELL = 20_000
#: A group of candidates with more shingles than this is cut into parts of about that many; a task meets two parts at a time.
PART = 4_000_000


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints and when two of these are linked.

    ``shingle`` words a shingle; ``words`` 64-bit words a fingerprint;
    ``segments`` as (first bit, bits) within it, each inside one word;
    ``slack`` as above; ``threshold`` bits by which linked ones may differ at most.
    With ``percent``, texts are linked if their sets of shingles have a
    Jaccard similarity of that many percent, and bits only give candidates.
    """

    shingle: int
    words: int
    segments: tuple[tuple[int, int], ...]
    slack: int
    threshold: int
    percent: int = 0


#: At most 4 of 64 bits differ, so one of three segments differs by at most 1: no link is missed.
FOUR_BITS = Scheme(4, 1, ((0, 21), (21, 21), (42, 22)), 1, 4)
#: Shingles of five words, similarity (Jaccard) of 0.8 or more. Texts at 0.8 differ in 39 of 256 bits on average, with a
#: deviation of 6, so 60 bits leave out about one pair in several thousand there, and fewer above.
SIMILAR = Scheme(5, 4, tuple((64 * w + 21 * k, 21) for w in range(4) for k in range(3)), 1, 60, 80)


@lru_cache(maxsize=1)
def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders modulo the generator of the low 12 bits and of the high 11 bits of a point."""

    def rest(v: int) -> int:
        for k in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - (LENGTH - DIMENSION))
        return v

    return np.array([rest(v) for v in range(1 << 12)]), np.array([rest(v << 12) for v in range(1 << 11)])


@lru_cache(maxsize=4)
def cosets(weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of at most ``weight`` bits by syndrome, the lightest first: (start of each syndrome, patterns, weights)."""
    low, high = syndromes()
    patterns = np.array([sum(1 << i for i in c) for w in range(weight + 1) for c in combinations(range(LENGTH), w)])
    of = low[patterns & 0xFFF] ^ high[patterns >> 12]
    order = np.argsort(of, kind="stable")
    return np.searchsorted(of[order], np.arange((1 << (LENGTH - DIMENSION)) + 1)), patterns[order], np.bitwise_count(patterns[order])


def anchors(points: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within ``RADIUS + slack`` of each point: (index of the point, anchor, whether it is at home there)."""
    low, high = syndromes()
    start, patterns, _ = cosets(RADIUS + slack)
    s = low[points & 0xFFF] ^ high[points >> 12]
    n = start[s + 1] - start[s]
    which = np.repeat(np.arange(len(points)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, (points[which] ^ patterns[start[s][which] + k]) >> (LENGTH - DIMENSION), k == 0


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text: ``width`` words joined by blanks, repeats included.

    A text with fewer words is one shingle; one without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes; later words take remixed hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        h = mixed(hashes + np.uint64(w)) if w else hashes
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _columns(scheme: Scheme) -> list[str]:
    return [f"f{k}" for k in range(scheme.words)]


def _sized(hashes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The hashes that a text's fingerprint and comparison take: each once if sets of shingles count."""
    return np.unique(hashes) if scheme.percent else hashes


def _row_key() -> F.Column:
    return F.xxhash64("doc_id", "text").alias("row")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", _row_key(), F.col("text").cast("binary").alias("text"))


def fingerprints(docs: DataFrame, scheme: Scheme = FOUR_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the words ``f0``, ``f1``, ... of every row's fingerprint, as signed longs; a null text is empty.

    Besides, ``row``, a hash of id and text, and ``shingles``, a hash of the
    set of shingles (0 if the scheme compares fingerprints only).
    """
    names = ["doc_id", "row", "shingles", *_columns(scheme)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, sets = np.zeros((b.num_rows, scheme.words), np.uint64), np.zeros(b.num_rows, np.uint64)
            for i, t in enumerate(b.column(2)):
                hashes = _sized(shingle_hashes(t.as_py() or b"", scheme.shingle), scheme)
                made[i] = fingerprint(hashes, scheme.words)
                if scheme.percent:
                    sets[i] = xxh64_intdigest(hashes.tobytes(), SEED)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets.view(np.int64)), *(pa.array(made[:, k].copy().view(np.int64)) for k in range(scheme.words))], names=names)

    return _rows(docs, doc_id, text).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _replicas(scheme: Scheme, only_cells: bool = False):
    """Rows for each fingerprint and anchor: cell, role (2 replica, 3 also at home), node and the fingerprint."""
    names = ["cell", "role", "node", *_columns(scheme)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 2000):
                b = big.slice(k, 2000)
                node, *words = (c.to_numpy() for c in b.columns)
                parts = []
                for s, (first, bits) in enumerate(scheme.segments):
                    points = (words[first // 64].view(np.uint64) >> np.uint64(first % 64)) & np.uint64((1 << bits) - 1)
                    which, anchor, home = anchors(points.astype(np.int64), scheme.slack)
                    parts.append((s << DIMENSION | anchor, np.where(home, 3, 2), which))
                cell, role, which = (np.concatenate(x) for x in zip(*parts, strict=True))
                arrays = [cell, role] if only_cells else [cell, role, node[which], *(w[which] for w in words)]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=names[: len(arrays)])

    return run, ", ".join(f"{n} long" for n in names[: 2 if only_cells else None])


def links_in_cell(words: np.ndarray, role: np.ndarray, threshold: int) -> np.ndarray:
    """A forest over the rows of a cell that connects what links connect: the label (a row) of each row.

    Those at home (role bit 1) are compared with the replicas (role bit 2), in
    blocks, so memory does not grow with the product of the two.
    """
    label = np.arange(len(role))
    homes, others = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    right = words[:, others]
    block = max(1, 2_000_000 // max(1, len(others)))
    for k in range(0, len(homes), block):
        left = words[:, homes[k : k + block]]
        far = np.zeros((left.shape[1], len(others)), np.uint16)
        for w in range(len(words)):
            far += np.bitwise_count(left[w][:, None] ^ right[w][None, :])
        near = far <= threshold
        for i in np.flatnonzero(near.sum(1) > (role[homes[k : k + block]] >> 1 & 1)):
            met = np.append(label[others[near[i]]], label[homes[k + i]])
            if (low := met.min()) != met.max():
                join = np.unique(met)
                label[np.isin(label, join[join != low])] = low
    return label


def _compare(scheme: Scheme):
    """Streams cells, whose rows come one after the other, and gives the links of each as a forest."""

    def edges(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        role, node, *words = np.concatenate(rows, axis=1)
        if len(role) < 2 or not (role & 1).any():
            return None
        label = links_in_cell(np.array(words).view(np.uint64), role, scheme.threshold)
        moved = np.flatnonzero(node[label] != node)
        return (node[moved], node[label[moved]]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            rest = np.array([c.to_numpy() for c in b.columns[1:]])
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if key[a] != cell:
                    if held and (e := edges(held)):
                        found.append(e)
                    cell, held = key[a], []
                held.append(rest[:, a:z])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        if held and (e := edges(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in e], names=["a", "b"])

    return run


def _gridded(replicas: DataFrame, sizes: DataFrame, scheme: Scheme) -> DataFrame:
    """Cut cells with too many rows into a grid: part i of those at home meets part j of the replicas in cell (i, j)."""
    big = sizes.select("cell", F.ceil(F.col("homes") / CELL).alias("p"), F.ceil(F.col("rows") / CELL).alias("q")).where("p * q > 1")
    big = saved(big, "cells")
    if not (n := big.count()):
        return replicas
    names = ["node", *_columns(scheme)]
    marked = replicas.join(F.broadcast(big) if n <= 10_000 else big, "cell", "left")
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    grid = lambda i, j: F.xxhash64("cell", i, j).alias("cell")
    whole = marked.where("p is null").select(F.xxhash64("cell").alias("cell"), "role", *names)
    cut = marked.where("p is not null")
    others = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select(grid(F.col("i"), part(F.col("q"), 1)), F.lit(2).cast("long").alias("role"), *names)
    homes = cut.where("role = 3").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select(grid(part(F.col("p"), 2), F.col("j")), F.lit(1).cast("long").alias("role"), *names)
    return whole.union(others).union(homes)


def similar_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels (a row) of sets that a Jaccard similarity of at least ``percent`` connects.

    Pivots meet all sets through the lists of who holds which member. Pairs
    that are connected already need no look, so only sets outside the largest
    group become pivots: at the end, of two sets in different groups one was.
    """
    n = len(sets)
    label, size = np.arange(n), np.array([len(x) for x in sets])
    owner = np.repeat(label, size)
    members, which = np.unique(np.concatenate(sets), return_inverse=True)
    held = owner[np.argsort(which, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(members)))])
    first = np.concatenate([[0], np.cumsum(size)])
    todo = np.ones(n, bool)
    while True:
        left = np.flatnonzero(todo & (label != np.bincount(label, minlength=n).argmax()))
        if not len(left):
            return label
        x = left[0]
        todo[x] = False
        own = which[first[x] : first[x + 1]]
        many = start[own + 1] - start[own]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[own], many)
        common = np.bincount(held[at], minlength=n)
        linked = 100 * common >= percent * (size + size[x] - common)
        linked[x] = True
        met = np.unique(label[linked])
        label[np.isin(label, met)] = met[0]


def _streamed(made):
    """For rows (cell, node, shingles) that come cell by cell: the links of each cell as a forest, by ``made(sets)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []

        def links() -> pa.RecordBatch | None:
            label = made(sets) if len(sets) > 1 else np.arange(len(sets))
            moved = np.flatnonzero(label != np.arange(len(sets)))
            ids = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"]) if len(moved) else None

        for b in batches:
            for c, node, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if c != cell:
                    if (e := links()) is not None:
                        yield e
                    cell, nodes, sets = c, [], []
                # Repeated rows come one after the other.
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.frombuffer(held.as_py(), np.uint64))
        if (e := links()) is not None:
            yield e

    return run


def confirmed(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, scheme: Scheme, doc_id: str, text: str) -> DataFrame:
    """The links between ``nodes`` (node, row) of one group of ``candidates`` (node, component) whose texts are similar.

    All pairs of a group count, whether or not their fingerprints are near. A
    group's sets of shingles meet in one task, those of a large group two parts
    in a task, for all pairs of parts.
    """
    wanted = nodes.join(candidates, "node").select("row", "node", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_sized(shingle_hashes(t.as_py() or b"", scheme.shingle), scheme) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["component", "node", "n", "held"])

    texts = _rows(docs, doc_id, text).select("row", "text").join(wanted, "row").select("component", "node", "text")
    sets = saved(texts.mapInArrow(run, "component long, node long, n long, held binary"), "shingles")
    big = saved(sets.groupBy("component").agg(F.ceil(F.sum("n") / PART).alias("p")).where("p > 1"), "large")
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("p"))
    marked = sets.join(F.broadcast(big), "component", "left").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("p"), F.lit(1)) - 1)))
    cell = F.when(F.col("p").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("component", F.least(part, "j"), F.greatest(part, "j")))
    cells = marked.select(cell.alias("cell"), "node", "held").repartition("cell").sortWithinPartitions("cell", "node")
    percent = scheme.percent
    return saved(cells.mapInArrow(_streamed(lambda s: similar_sets(s, percent)), "a long, b long"), "edges")


def _grouped(docs: DataFrame, scheme: Scheme, doc_id: str, text: str) -> DataFrame:
    """Every row's ``doc_id``, ``row``, fingerprint words, ``component`` and ``component_id``."""
    words = _columns(scheme)
    node = F.xxhash64(*words, "shingles") if scheme.percent else F.col("f0") if scheme.words == 1 else F.xxhash64(*words)
    made = saved(fingerprints(docs, scheme, doc_id, text).withColumn("node", node), "fingerprints")
    nodes = saved(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"), *(F.any_value(w).alias(w) for w in words)), "nodes")
    points = nodes.select("node", *words)
    run, schema = _replicas(scheme, only_cells=True)
    sizes = points.mapInArrow(run, schema).groupBy("cell").agg(F.sum(F.col("role") - 2).alias("homes"), F.count(F.lit(1)).alias("rows"))
    run, schema = _replicas(scheme)
    cells = _gridded(points.mapInArrow(run, schema), sizes, scheme)
    edges = saved(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(scheme), "a long, b long"), "edges")
    reached = connected_components(edges)
    if scheme.percent:
        # The smallest node of a component has no row in what reaches it.
        found = reached.union(reached.select(F.col("component").alias("node"), "component")).distinct()
        reached = connected_components(confirmed(docs, nodes.select("node", "row"), found, scheme, doc_id, text))
    both = nodes.select("node", "least", "rows").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = both.where(F.col("component").isNotNull())
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    table = saved(lookup_join(linked, least, "component").select("node", "component", "component_id", "rows"), "components")
    heavy = [r[0] for r in table.where(F.col("rows") >= CELL).orderBy(F.desc("rows")).limit(1000).select("node").collect()]
    return lookup_join(made, table.drop("rows"), "node", "left", heavy)


def near_duplicates(docs: DataFrame, scheme: Scheme = FOUR_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint (hex, 16 digits a word) and ``component_id``, the smallest id that links reach from it.

    Rows with one fingerprint (and one set of shingles, if the scheme has a
    ``percent``) count once from there on; links are found between the others
    only and kept as forests, never as all pairs of a group. A null text counts
    as empty (fingerprint zero, linked like any other); rows with a null id
    take part and have a null component if they reach no other; repeated rows
    give a row each; other columns are ignored; an empty table gives no rows.
    """
    digits = F.concat(*(F.lpad(F.lower(F.hex(w)), 16, "0") for w in _columns(scheme)))
    return _grouped(docs, scheme, doc_id, text).select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, scheme: Scheme = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of each group of near-duplicates, in their own columns.

    Rows without an id stay as they are. Of rows with one id and similar texts,
    one stays; those with unlike texts are in groups of their own and stay.
    """
    found = _grouped(docs, scheme, doc_id, text)
    least = found.where(F.col("doc_id") == F.col("component_id"))
    keep = least.groupBy("component", "doc_id").agg(F.min("row").alias("__hash")).select(F.col("doc_id").alias("__kept"), "__hash")
    key = F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    ours = docs.withColumn("__row", key).join(keep, (F.col(doc_id).cast("long") == F.col("__kept")) & (F.col("__row") == F.col("__hash")), "left_semi")
    return ours.dropDuplicates([doc_id, "__row"]).drop("__row").unionByName(docs.where(F.col(doc_id).isNull()))
