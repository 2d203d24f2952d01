"""Sum-of-squares packing of tokenized documents into fixed-size training sequences."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
#: A sequence id is the number of its partition times this plus its number there.
PER_PARTITION = 1 << 36
#: The pattern by which byte-level vocabularies of this family split text before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, reversed."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder with the vocabulary of a tokenizers JSON file with byte-level BPE.

    Such a file lists tokens in merge order, so its ids are also the ranks that
    tiktoken wants; tiktoken gives the same ids several times faster. Special
    tokens' strings in a text are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, of = spec.get("added_tokens", []), byte_alphabet()
    if odd := [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that take in their surroundings are not supported: {odd}")
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def encoding(path: str) -> Callable[[str], list[int]]:
    """The ids of a text by the vocabulary file, added tokens included."""
    own = encoder(path)
    every = own.special_tokens_set
    return lambda text: own.encode(text, allowed_special=every)


class Levels:
    """Partly filled windows by fill level, with the sum-of-squares rule for the next piece.

    ``count[f]`` windows are filled to level ``f``. Putting a piece of ``s``
    tokens into a window at ``f`` moves one window from ``f`` to ``f + s``,
    which changes the sum of squared counts by ``2 (count[f + s] - count[f] + 1)``;
    a new window changes it by ``2 count[s] + 1``; a window that becomes full
    leaves the sum. The least change wins, the fuller window on ties.
    """

    def __init__(self, size: int = SEQUENCE):
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)

    def place(self, s: int) -> tuple[int | None, int]:
        """Choose for a piece of ``s`` tokens (1 to size): the level to put it at, with its window; (None, 0) for a new one."""
        c, best, at = self.count, 2 * int(self.count[s]) + 1 if s < self.size else 0, 0
        top = self.size - s
        if top > 0:
            change = 2 * (c[1 + s : top + s + 1] - c[1 : top + 1]) + 2
            change[-1] = 1 - 2 * c[top]  # the window becomes full
            change[c[1 : top + 1] == 0] = np.iinfo(np.int64).max
            k = top - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                at = k + 1
        if not at:
            return None, 0
        self.count[at] -= 1
        return self.open[at].pop(), at

    def keep(self, window: int, level: int) -> None:
        """Note that a window is now filled to ``level``."""
        if level < self.size:
            self.count[level] += 1
            self.open[level].append(window)


def pack(lengths: Iterator[int], size: int = SEQUENCE) -> Iterator[tuple[int, int, int, int, int]]:
    """Pack documents of these token counts; yields (document, start, length, sequence, offset) of each piece.

    A document's full windows come first and stand alone; what is left, or a
    whole short document, is one piece that the level rule places. At the end
    the windows that are still open are emptied into one stream of pieces,
    ordered by fill, which is cut anew into full windows; its last part is cut
    into powers of two, which need no padding. Nothing is lost or repeated. A
    count of zero yields no piece. Held in memory: one small tuple for each
    piece in an open window.
    """
    levels, contents, made = Levels(size), {}, 0
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= size:
            yield doc, at, size, made, 0
            at, made = at + size, made + 1
        if not (s := n - at):
            continue
        window, offset = levels.place(s)
        if window is None:
            window, made = made, made + 1
            contents[window] = []
        contents[window].append((doc, at, s, offset))
        if offset + s == size:
            for d, b, k, o in contents.pop(window):
                yield d, b, k, window, o
        else:
            levels.keep(window, offset + s)
    # The ids of emptied windows are used again; a few may be left over, so ids can have gaps.
    free = sorted(contents)
    left = [p for w in sorted(contents, key=lambda w: (-(contents[w][-1][3] + contents[w][-1][2]), w)) for p in contents[w]]
    rest = sum(p[2] for p in left)
    room, fill = 0, 0
    window, pieces = None, iter(left)
    doc = at = k = 0
    while rest:
        if not k:
            doc, at, k, _ = next(pieces)
        if not room:
            window, fill = (free.pop(0), 0) if free else (made, 0)
            made += window == made
            room = size if rest >= size else 1 << (rest.bit_length() - 1)
        take = min(k, room)
        yield doc, at, take, window, fill
        at, k, room, fill, rest = at + take, k - take, room - take, fill + take, rest - take


def packed(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``size`` tokens: one row for each piece.

    Each document is the ids of its whole text and then id 0, so an empty or
    null text is one token; a null ``doc_id`` stays null; repeated rows are
    packed each for itself; other columns are ignored; an empty table gives no
    rows. Every partition packs its own documents in one pass over the scan,
    without a shuffle; only its last few sequences are shorter than ``size``,
    and those have a power of two of tokens, so nothing is padded. Sequence ids
    are unique over all partitions. Of a document, only the ids of a piece in a
    window that is still open stay in memory.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * PER_PARTITION
        encode = encoding(tokenizer_path)
        # Of each document that is not wholly placed: its id, its tokens in all, how many are placed, and its ids from a place on.
        held: dict[int, tuple[int | None, int, int, int, np.ndarray]] = {}
        rows: list[tuple] = []

        def lengths() -> Iterator[int]:
            k = 0
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tokens = np.array(encode(t.as_py() or "") + [0], dtype="<u4")
                    held[k] = (d, len(tokens), 0, 0, tokens)
                    yield len(tokens)
                    if k in held:  # its full windows are placed: only the rest is still wanted
                        d, n, placed, _, tokens = held[k]
                        held[k] = (d, n, placed, n - n % size, tokens[n - n % size :].copy())
                    k += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for k, start, length, sequence, offset in pack(lengths(), size):
            d, n, placed, first, tokens = held[k]
            rows.append((d, start, length, zlib.crc32(tokens[start - first : start - first + length].tobytes()), n, base + sequence, offset))
            if placed + length == n:
                del held[k]
            else:
                held[k] = (d, n, placed + length, first, tokens)
            if len(rows) >= 20_000:
                yield out()
        if rows:
            yield out()

    return docs.mapInArrow(run, SCHEMA)
