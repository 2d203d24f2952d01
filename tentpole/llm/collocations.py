"""Collocations: phrases that occur more often than their parts suggest, counted with hashed buckets and Apriori pruning.

One pass over the texts for each phrase length. While phrases of k words are
counted exactly, those of k + 1 are counted by the bucket that their hash falls
in. A phrase is counted in the next pass only if its bucket was full enough and
both its parts without an end word were frequent. Both tests are bitmaps of a
fixed number of bits that every task gets; they can only let too much through,
never too little, and the exact count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tentpole.llm.common import dropped, lookup_join, saved

#: Occurrences that a phrase needs, words of the longest phrase, and rows of a language's report.
SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Base-2 logarithm of the bits of a bitmap: 2**22 bits are half a megabyte.
BITS = 22
#: Bytes of text whose phrases are counted together.
CHUNK = 4_000_000
#: Buckets that are summed together.
BLOCK = 4096
#: Parts of a language whose phrases are ranked before they are ranked together.
PARTS = 64
#: Multiplier of the phrase hash (fixed value).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD, GAP, END = 0, 1, 2
#: What each byte is: part of a word, white space between words, or the end of a piece; and its lower case for A to Z.
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
LOWER[ord("A") : ord("Z") + 1] += 32
SCHEMA = "lang string, phrase string, h long, n long, counts binary"


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, by sums over all words' bytes, and its length."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), x, np.uint64)]) for x in (MULTIPLIER, INVERSE))
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]
    return spread((total[ends[1:]] - total[ends[:-1]]) * down[ends[:-1]] + np.diff(ends).astype(np.uint64))


class Words:
    """The words of some texts: codes by exact spelling, their pieces and languages, and a hash of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        parts = texts.cast(pa.binary()).to_pylist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)  # a line end closes the last piece of each text
        del parts
        kind = KIND[raw]
        inside = kind == WORD
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = LOWER[raw[inside]]
        spelled = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, np.cumsum(last - first)].astype(np.int64)), pa.py_buffer(letters))
        coded = spelled.dictionary_encode()
        self.codes, self.spelling = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.piece = np.cumsum(kind == END, dtype=np.int32)[first]
        of_text = np.diff(np.searchsorted(first, np.cumsum(np.r_[0, sizes + 1])))
        tongue = langs.dictionary_encode()
        self.tongues = tongue.dictionary.cast(pa.large_string())
        self.lang = np.repeat(tongue.indices.to_numpy().astype(np.int64), of_text)
        self.hash = word_hashes(self.spelling)[self.codes]
        self.seed = word_hashes(self.tongues)[self.lang]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """Hashes of the phrases of 1, 2, ... words from each word on, with the language; where a phrase leaves its piece they mean nothing."""
        h, out, n = spread(self.seed + self.hash), [], len(self.codes)
        for k in range(1, longest + 1):
            out.append(h)
            h = spread(h[: n - k] * MULTIPLIER + self.hash[k:]) if n > k else np.zeros(0, np.uint64)
        return out

    def starts(self, k: int) -> np.ndarray:
        """Whether a phrase of k words begins at each word but the last k - 1: within one piece."""
        n = len(self.codes) - k + 1
        return self.piece[: max(n, 0)] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def counted(self, at: np.ndarray, h: np.ndarray, k: int) -> pa.RecordBatch:
        """Exact counts of the phrases of k words at some places, whose hashes are given: columns of ``SCHEMA``."""
        if k == 1:
            key = self.lang[at] * len(self.spelling) + self.codes[at]
            n = np.bincount(key, minlength=0)
            where = np.zeros(len(n), np.int64)
            where[key] = np.arange(len(key))  # a place of each
            some = np.flatnonzero(n)
            n, first = n[some], where[some]
        else:
            _, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            lead = at[first][of]
            if not (all((self.codes[at + j] == self.codes[lead + j]).all() for j in range(k)) and (self.lang[at] == self.lang[lead]).all()):
                # Phrases with one hash are told apart by all their words.
                _, first, n = np.unique(np.stack([self.lang[at], *(self.codes[at + j] for j in range(k))]), axis=1, return_index=True, return_counts=True)
        where = at[first]
        words = [self.spelling.take(pa.array(self.codes[where + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
        return batch_of(self.tongues.take(pa.array(self.lang[where])), phrase, h[first].view(np.int64), n)

    def totals(self) -> pa.RecordBatch:
        """The words of each language, under the empty phrase."""
        n = np.bincount(self.lang, minlength=len(self.tongues))
        return batch_of(self.tongues, pa.array([""] * len(n), pa.large_string()), np.zeros(len(n), np.int64), n)


def batch_of(lang: pa.Array, phrase: pa.Array, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.binary())], names=["lang", "phrase", "h", "n", "counts"])


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def holds(bitmap: bytes, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash's bucket is set; the lowest bit of a byte comes first."""
    of = np.frombuffer(bitmap, np.uint8)
    at = bucket(h, (8 * len(of)).bit_length() - 1)
    return (of[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pass(k: int, longest: int, bits: int, support: int, full, frequent):
    """One pass: counts of phrases of k words, in the first those of each language's words, and a task's bucket counts of k + 1 words.

    Buckets are given in blocks: ``h`` is the block, ``counts`` has a number for
    each bucket, ``support`` standing for itself and more. Nothing grows with
    what a task reads but the blocks, which have a fixed size.
    """
    kind = np.min_scalar_type(support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << bits, np.int32) if k < longest else None
        for texts, langs in chunks(batches):
            words = Words(texts, langs)
            h = words.hashes(min(k + 1, longest))
            may = words.starts(k)
            if k > 1:
                ok = holds(frequent.value, h[k - 2])
                may &= holds(full.value, h[k - 1]) & ok[: len(may)] & ok[1 : len(may) + 1]
            at = np.flatnonzero(may)
            yield words.counted(at, h[k - 1][at], k)
            if k == 1:
                yield words.totals()
            if buckets is not None:
                # A longer phrase is worth counting only if both its parts are counted here.
                longer = words.starts(k + 1)
                longer &= may[: len(longer)] & may[1 : len(longer) + 1]
                np.add.at(buckets, bucket(h[k][: len(longer)][longer], bits), 1)
                np.minimum(buckets, support, out=buckets)
        if buckets is not None and buckets.any():
            parts = buckets.astype(kind).reshape(-1, BLOCK)
            for i in range(0, len(parts), 256):
                some = parts[i : i + 256]
                nothing = pa.nulls(len(some), pa.string())
                yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(np.arange(i, i + len(some))), pa.nulls(len(some), pa.int64()), pa.array([x.tobytes() for x in some], pa.binary())], names=["lang", "phrase", "h", "n", "counts"])

    return run


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of so many rows together as have about ``CHUNK`` bytes."""
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
            part = b.slice(at, upto - at)
            yield part.column(0), part.column(1)
            at = upto


def _full_buckets(support: int):
    """For blocks of bucket counts, sorted by block: which buckets of each reach the support, as bits."""
    kind = np.min_scalar_type(support)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= support, bitorder="little").tobytes()], pa.binary())], names=["h", "bits"])

        for b in batches:
            for x, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if x != block:
                    if block is not None:
                        yield out()
                    block, total = x, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(counts.as_buffer(), kind)
        if block is not None:
            yield out()

    return run


def full_buckets(counts: DataFrame, support: int, bits: int) -> bytes:
    """A bitmap of the buckets whose counts over all tasks reach the support: the driver gets the bits alone."""
    out = bytearray((1 << bits) // 8)
    for block, part in counts.select("h", "counts").repartition("h").sortWithinPartitions("h").mapInArrow(_full_buckets(support), "h long, bits binary").collect():
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = part
    return bytes(out)


def bitmap_of(df: DataFrame, h: str, bits: int) -> bytes:
    """A bitmap of 2**bits bits with those of column ``h`` (bucket numbers) set: built by Spark, so the driver gets the bits alone."""
    numbered = df.select(F.bitmap_bucket_number(F.col(h) + 1).alias("block"), F.bitmap_bit_position(F.col(h) + 1).alias("bit"))
    out = bytearray((1 << bits) // 8)
    for block, part in numbered.groupBy("block").agg(F.bitmap_construct_agg("bit")).collect():
        out[(block - 1) * 4096 : block * 4096] = part
    return bytes(out)


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every phrase of 1 to ``longest`` words with at least ``support`` occurrences in its language: ``lang``, ``phrase``, ``k`` (words), ``f``; an empty phrase with k = 0 holds the language's words.

    Texts are lower-cased (A to Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]``
    and those into words ``[^\\x20\\x09]+``; occurrences lie within a piece and
    may overlap. A null language is ``und``; null and empty texts have no
    words; every row counts, repeated or not; other columns are ignored; an
    empty table gives no rows. ``bits`` (15 or more) sets the size of the two
    bitmaps, not the result: with a corpus for which they are too small they
    let more phrases through to the exact count.
    """
    if not 15 <= bits <= 30:
        raise ValueError("bitmaps have 2**15 to 2**30 bits")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    found, full, frequent = None, None, None
    for k in range(1, longest + 1):
        # The counts of a pass are written as they come, so that phrases and buckets, which go different ways, need one scan.
        made = saved(docs.mapInArrow(_pass(k, longest, bits, support, full, frequent), SCHEMA), f"pass{k}")
        summed = made.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("h").alias("h"))
        now = saved(summed.where((F.col("f") >= support) | (F.col("phrase") == "")), f"phrases{k}")
        phrases = now.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(k).alias("k"), "f")
        found = phrases if found is None else found.unionByName(phrases)
        if k == longest:
            dropped(made)
            break
        # Hashes are unsigned; their upper bits are the bucket.
        own = now.where("phrase <> ''").select(F.shiftrightunsigned("h", 64 - bits).alias("h"))
        full, frequent = (spark.sparkContext.broadcast(x) for x in (full_buckets(made.where("phrase IS NULL"), support, bits), bitmap_of(own, "h", bits)))
        dropped(made)
        if not any(full.value):
            break
    return found


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, bits: int = BITS, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of two words or more of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest
    cut, ``n`` the language's words; the score is floor(1000 a n / (l r)), exact
    in 38 digits; equal scores go to the earlier cut. A phrase that stands in a
    longer one as often as anywhere is left out. Order: score, then ``a``, both
    falling, then the phrase by its bytes. See :func:`frequent_phrases` for
    texts, nulls, repeated rows and empty tables.
    """
    all_found = frequent_phrases(docs, support, longest, bits, text, lang)
    key = lambda phrase: F.concat_ws("\t", "lang", phrase)  # noqa: E731  a phrase holds no tab, so the last one parts the two
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    candidates = all_found.where("k >= 2").withColumn("words", words)
    # How often the longer candidates around a phrase occur: its own parts look up whom they are in.
    inner = candidates.where("k >= 3").select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    around = inner.groupBy(key(part(F.col("at"), F.col("m"))).alias("whole")).agg(F.max("f").alias("longer"))
    kept = candidates.withColumn("whole", key("phrase")).join(around, "whole", "left").where("longer IS NULL OR longer < f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = saved(cuts.select("lang", "phrase", "a", "cut", key(part(F.lit(1), F.col("cut"))).alias("left"), key(part(F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right")), "cuts")
    table = all_found.where("k >= 1").select(key("phrase").alias("left"), F.col("f").alias("l"))
    cuts = lookup_join(cuts, table, "left")
    cuts = lookup_join(cuts, table.select(F.col("left").alias("right"), F.col("l").alias("r")), "right")
    total = all_found.where("k = 0").select("lang", F.col("f").alias("n"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    above = (big("a") * F.lit(1000)).cast("decimal(19,0)") * big("n")
    scored = lookup_join(cuts, total, "lang").withColumn("score", F.call_function("div", above, big("l") * big("r")))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # A language may hold nearly all phrases: each of its parts keeps its first ones, so that the last ranking sees PARTS * top rows at most.
    order, part_of = (F.desc("score"), F.desc("a"), F.col("phrase")), F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = weakest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part_of).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
