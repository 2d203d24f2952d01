"""Toxicity by a weighted grammar: clauses are read by composed transducers, their matches weighed by a fitted model.

Words of function (who is meant, denied or quoted) are fixed lists. Which words
insult is learned: words and word beginnings that stand in many different
contexts of documents labelled toxic and hardly in others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tentpole.llm import transducers as t
from tentpole.llm.common import dropped, saved

WORDS = re.compile(r"[^\W\d_]+")
#: What parts clauses; not a colon, so what is said stands with who says it.
CLAUSE = re.compile(r"[.!?;\n]+")
#: Labelled rows of either class that are learned from: the first by hash of their id.
SAMPLE = 8000
#: Lengths of word beginnings that may be learned, beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A term is learned if it stands after at least so many different words (of 64 told apart), in at least this share of
#: the toxic documents of the sample and in at least so many, with at least this log-odds.
#: The sample bounds their number: a document has a few thousand terms, and each has to be in 16 of 8,000 at least.
CONTEXTS, SHARE, LEAST_DOCS, LOG_ODDS = 8, 0.002, 4, 4.0
THRESHOLD = 0.7
#: Word lists of four languages.
LISTS = {
    t.THREAT: "kill hurt destroy beat stab shoot burn hang punish töten schlagen vernichten verprügeln umbringen tuer frapper détruire brûler matar golpear destruir quemar",
    t.TARGET: "you your yours yourself they them their he him she her people everyone du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre tú ti usted ustedes vosotros",
    t.NOT: "not never none neither nor without isn aren wasn don doesn nicht kein keine nie niemals pas jamais aucun sans nunca jamás ningún sin",
    t.REPORT: "said says say told tells called calls wrote writes quoted reported alleged claimed sagte sagt schrieb nannte behauptete dit écrit appelle affirme dijo dice escribió llamó",
}
CLASSES = {w: k for k, words in LISTS.items() for w in words.split()}
FEATURES = (t.BARE, t.AIMED, t.DENIED, t.TOLD, t.MENACE)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Lexicon:
    """Learned terms with their weights: whole words and beginnings."""

    words: dict[str, float]
    beginnings: dict[str, float]

    def weight(self, word: str) -> float:
        w = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n and (x := self.beginnings.get(word[:n], 0.0)) > w:
                w = x
        return w


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features - self.mean) / self.spread @ self.weights + self.bias, -30, 30)))


def terms_of(word: str) -> Iterator[tuple[str, bool]]:
    """(term, whole word?): a word and its beginnings."""
    yield word, True
    for n in BEGINNINGS:
        if len(word) > n:
            yield word[:n], False


@lru_cache(maxsize=1)
def _grammar() -> tuple[t.Transducer, t.Transducer]:
    return t.grammar(), t.named_after()


def clauses(text: str, weigh) -> Iterator[tuple[str, float]]:
    """Each clause that the grammar matches: what it does, and the weight of its reading.

    A clause does what the strongest match in it does (threatens, aims an
    insult, insults without a target, reports or denies one); its weight is
    that of the whole path: the matched words' weights, each raised by a target
    and lowered by a negation or a report. Clauses without an insult or
    threatening verb match nothing and are not read.
    """
    machine, mirrored = _grammar()
    for clause in CLAUSE.split(text.lower()):
        words = WORDS.findall(clause)
        weights = list(map(weigh, words))
        if not any(weights) and t.THREAT not in map(CLASSES.get, words):
            continue
        symbols = [t.INSULT if x else CLASSES.get(w, t.OTHER) for w, x in zip(words, weights, strict=True)]
        found = [(max(0.0, 1 + extra) * (x or 1.0), kind) for (kind, extra), x in zip(t.read(machine, mirrored, symbols), weights, strict=True) if kind in FEATURES]
        if found:
            yield max(found)[1], sum(w for w, _ in found)


def features(text: str, weigh) -> list[float]:
    """What the clauses of the whole text do: for each kind log(1 + clauses) and log(1 + their weight), then for all clauses."""
    counts, mass = dict.fromkeys(FEATURES, 0), dict.fromkeys(FEATURES, 0.0)
    for kind, weight in clauses(text, weigh):
        counts[kind] += 1
        mass[kind] += weight
    return [*(np.log1p(counts[k]) for k in FEATURES), *(np.log1p(mass[k]) for k in FEATURES), np.log1p(sum(counts.values()))]


class Weigher(dict):
    """Weight of each word in a lexicon, remembered for a bounded number of words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = w = self.lexicon.weight(word)
        return w


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term: documents of either label that have it, and the different words before it (64 told apart) in toxic ones."""
    for big in batches:
        for k in range(0, big.num_rows, 1000):
            b = big.slice(k, 1000)
            found: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: dict[tuple[str, bool], int] = {}
                before = ""
                for w in WORDS.findall((text or "").lower()):
                    bit = 1 << (crc32(before.encode()) & 63)
                    for term in terms_of(w):
                        own[term] = own.get(term, 0) | bit
                    before = w
                for term, mask in own.items():
                    x = found.setdefault(term, [0, 0, 0])
                    x[toxic] += 1
                    if toxic:
                        x[2] |= mask
            if found:
                rows = [(term, whole, n0, n1, mask - (1 << 64) if mask >> 63 else mask) for (term, whole), (n0, n1, mask) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["term", "whole", "n0", "n1", "mask"])


def learned(sample: DataFrame) -> Lexicon:
    """The terms of insults in a labelled sample (``text``, ``toxic``), with log-odds as weights.

    A term that only many copies of one text share has few contexts and stays
    out, whatever the number of copies. The strongest terms come first, of
    equals the shorter. A longer term that says no more than a learned
    beginning of it is left out; so is a beginning that says too little apart
    from the longer terms already learned.
    """
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    found = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, whole boolean, n0 long, n1 long, mask long").groupBy("term", "whole").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_or("mask").alias("mask"))
    found = found.where(F.col("n1") >= max(LEAST_DOCS, SHARE * n1)).withColumn("odds", odds).where((F.col("odds") >= LOG_ODDS) & (F.bit_count("mask") >= CONTEXTS))
    words, beginnings = {}, {}
    # For each beginning, the toxic documents of terms already learned that have it.
    longer: dict[str, int] = {}
    for r in sorted(found.collect(), key=lambda r: (-round(2 * r["odds"]), len(r["term"]), r["term"], r["whole"])):
        term, whole, w = r["term"], r["whole"], float(r["odds"])
        if any(beginnings.get(term[:n], -1.0) >= w - 1 for n in BEGINNINGS if n < len(term) or whole and n == len(term)):
            continue
        left = r["n1"] - (0 if whole else longer.get(term, 0))
        if left < max(LEAST_DOCS, SHARE * n1) or np.log((left + 0.5) / (n1 + 1)) - np.log((r["n0"] + 0.5) / (n0 + 1)) < LOG_ODDS:
            continue
        (words if whole else beginnings)[term] = w
        for n in BEGINNINGS:
            if n <= len(term):
                longer[term[:n]] = longer.get(term[:n], 0) + r["n1"]
    return Lexicon(words, beginnings)


def fitted(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, ridge: float = 0.01, steps: int = 50) -> Model:
    """Logistic regression by Newton steps, classes weighed alike; without both classes, nothing is toxic."""
    width = len(features("", lexicon.weight))
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicon, np.zeros(width), np.ones(width), np.zeros(width), 5.0 if len(y) and y.min() else -5.0)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    penalty = ridge * np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (share * (p - y)) / len(y) + penalty * w
        step = np.linalg.solve((z.T * (share * p * (1 - p))) @ z / len(y) + np.diag(penalty + 1e-9), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, mean, spread, w[:-1], float(w[-1]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that labels are not learned from: crc32 of the id as text leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and weights from labelled rows (``doc_id``, ``text``) that are not held out, ``SAMPLE`` of either class at most.

    Equal texts count once, so copies weigh no more than one. Labels other than
    0 and 1 are passed over; a document labelled both ways counts as toxic.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("toxic").cast("int").alias("toxic")).where(F.col("of").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("of")).groupBy("of").agg(F.max("toxic").alias("toxic"))
    first = lambda k: own.where(F.col("toxic") == k).orderBy(F.xxhash64("of"), "of").limit(SAMPLE)
    some = docs.join(F.broadcast(first(0).unionByName(first(1))), F.col("doc_id") == F.col("of")).select(F.col("text"), "toxic").where("text is not null").dropDuplicates(["text"])
    sample = saved(some, "labelled")
    lexicon = learned(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(lexicon).__getitem__
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(x, weigh) for x in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x array<double>, y int").collect()
    dropped(sample)
    order = sorted((tuple(r["x"]), r["y"]) for r in rows)
    return fitted(np.array([r[0] for r in order]), np.array([r[1] for r in order], float), lexicon)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score and verdict of every document over its whole text, in one pass without a shuffle.

    A null text is empty and scores as such; null ids and repeated rows give a
    row each; columns other than id and text are ignored, so labels, language
    and source cannot enter a score. Without labels of both classes nothing is
    toxic; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(trained(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weigh = Weigher(m.lexicon).__getitem__
        for b in batches:
            if not b.num_rows:
                continue
            s = m.scores(np.array([features(x.as_py() or "", weigh) for x in b.column(1)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, SCHEMA)
