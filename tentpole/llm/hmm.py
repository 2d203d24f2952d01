"""A hidden Markov language model: Baum-Welch counts from all partitions, exact scaled forward scores.

The model's symbols are a bounded number of frequent words (the head), the end
of a text, and classes of all other words by their first and last letters. A
word outside the head has the probability of its class in the state, times its
own share of the class, which no state changes. So the states need few numbers,
whatever the vocabulary, and counts of rare words are joined, not broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.llm.common import saved

#: Words that are symbols of their own, and those whose counts every worker holds: fixed bounds on what is broadcast.
HEAD, KNOWN = 50_000, 200_000
CLASSES = 4096
STATES = 12
#: Baum-Welch passes over all training documents.
PASSES = 3
#: Training begins with how often the most frequent symbols, so many, stand together within so many tokens of a text.
MARKS, SPAN = 256, 128
#: Pseudo-counts that each state's emissions take from the unigram distribution: during training, and those tried at its end
#: on one in so many of the training documents.
PRIOR, PRIORS, PART = 2000.0, (500.0, 2000.0, 5000.0, 20_000.0), 10
#: Tokens worked on at once; of a longer text, forward values are kept at cuts so far apart and worked out again between them.
GROUP = 250_000
#: Tokens whose emissions are looked up at once, few enough for a processor's cache.
BLOCK = 8192
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than blank and \\x09-\\x0D."""
    return text.lower().split() if text else []


def class_of(word: bytes) -> int:
    """One of ``CLASSES`` classes by the first two and the last three bytes."""
    return zlib.crc32(word[:2] + b" " + word[-3:]) % CLASSES


def classes(word: str) -> Column:
    """:func:`class_of` over a column."""
    return (F.crc32(F.concat(F.substring(word, 1, 2), F.lit(b" "), F.substring(word, -3, 3))) % CLASSES).cast("int")


@dataclass
class Vocabulary:
    """Head words by number (0 is the end of a text), counts of known words, and totals."""

    number: dict[bytes, int]
    count: dict[bytes, int]
    ends: int
    tokens: int
    distinct: int
    #: Of each class, words outside the head: log10 of tokens + distinct + 1.
    class_log: np.ndarray
    unigram: np.ndarray
    #: Symbols of the known words, in the order of ``count``.
    codes: np.ndarray

    @property
    def code(self) -> type:
        """What a symbol is stored as."""
        return np.uint16 if len(self.unigram) <= 1 << 16 else np.int32

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbol of each word and of the end."""
        n, base = self.number.get, len(self.number) + 1
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = [k if (k := n(w)) is not None else base + class_of(w) for w in words]
        return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def single(self) -> Model:
        """In single precision, which is enough for counts that are summed in double; scores stay in double."""
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


class Batch:
    """Texts side by side, longest first: at step t the first ``active[t]`` go on. All arrays are in order of (step, text).

    Values of states are rows, so that what a step does to its texts runs along
    memory. Every text has a symbol at least, its end.
    """

    def __init__(self, texts: list[np.ndarray]):
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        n = np.array([len(texts[i]) for i in self.order])
        self.active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        self.symbols = np.empty(len(which), np.int32)
        self.symbols[self.begin[step] + which] = np.concatenate([texts[i] for i in self.order])

    def parts(self, size: int) -> list[tuple[int, int]]:
        """All steps, cut after about every ``size`` tokens."""
        cuts = np.unique(np.concatenate([np.searchsorted(self.begin, np.arange(0, self.begin[-1], size)), [len(self.active)]]))
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def _emitted(self, m: Model, t0: int, t1: int) -> np.ndarray:
        """Each state's probabilities of the symbols of steps ``t0`` to ``t1``."""
        symbols = self.symbols[self.begin[t0] : self.begin[t1]]
        out = np.empty((len(m.start), len(symbols)), m.emit.dtype)
        for k in range(0, len(symbols), BLOCK):
            out[:, k : k + BLOCK] = m.emit.take(symbols[k : k + BLOCK], 0).T
        return out

    def _run(self, m: Model, t0: int, t1: int, a: np.ndarray | None, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward values and scales of steps ``t0`` to ``t1`` after forward values ``a``."""
        begin, move = (self.begin[t0 : t1 + 1] - self.begin[t0]).tolist(), np.ascontiguousarray(m.move.T)
        alpha, scale = np.empty_like(emitted), np.empty(begin[-1], m.emit.dtype)
        for i, j in zip(begin, begin[1:], strict=False):
            x, c = alpha[:, i:j], scale[i:j]
            if a is None:
                x[:] = m.start[:, None]
            else:
                np.matmul(move, a[:, : j - i], out=x)
            x *= emitted[:, i:j]
            np.add.reduce(x, 0, out=c)
            x *= 1 / c
            a = x
        return alpha, scale

    def _last(self, alpha: np.ndarray, t: int) -> np.ndarray:
        """The values of step ``t``, with which ``alpha`` ends."""
        return alpha[:, alpha.shape[1] - self.active[t] :].copy()

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """log10 likelihood of each text, in the given order, and the last forward values."""
        total, a = np.zeros(self.active[0]), None
        for t0, t1 in self.parts(BLOCK):
            alpha, scale = self._run(m, t0, t1, a, self._emitted(m, t0, t1))
            a, logs = self._last(alpha, t1 - 1), np.log(scale)
            for t, i in enumerate((self.begin[t0:t1] - self.begin[t0]).tolist(), t0):
                total[: self.active[t]] += logs[i : i + self.active[t]]
        out = np.empty(len(total))
        out[self.order] = total / np.log(10)
        return out, a.T

    def counts(self, m: Model, emissions: np.ndarray, group: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Expected counts of whole texts: log10 likelihood, starts, moves; those of emissions (state by symbol) are added to ``emissions``.

        Forward values are kept for about ``group`` tokens at a time. A longer
        batch is run through once to have them at cuts, then again from cut to
        cut, last part first.
        """
        states, total, entry, a, alpha = len(m.start), 0.0, [], None, None
        parts = self.parts(group or GROUP)
        for t0, t1 in parts:
            entry.append(a)
            emitted = self._emitted(m, t0, t1)
            alpha, scale = self._run(m, t0, t1, a, emitted)
            a = self._last(alpha, t1 - 1)
            total += np.log(scale).sum(dtype=np.float64)
        moves, starts = np.zeros((states, states)), np.zeros(states)
        # What lies ahead of the last step of a part, for the texts that go on after it.
        after = np.ones((states, 0), m.emit.dtype)
        for (t0, t1), before in zip(parts[::-1], entry[::-1], strict=True):
            if alpha is None:
                emitted = self._emitted(m, t0, t1)
                alpha, scale = self._run(m, t0, t1, before, emitted)
            begin = (self.begin[t0 : t1 + 1] - self.begin[t0]).tolist()
            beta = np.ones_like(alpha)
            beta[:, begin[-2] : begin[-2] + after.shape[1]] = after
            emitted /= scale
            for h, i, j in zip(begin[-3::-1], begin[-2:0:-1], begin[:1:-1], strict=True):
                ahead = emitted[:, i:j]
                ahead *= beta[:, i:j]
                np.matmul(m.move, ahead, out=beta[:, h : h + j - i])
            first = begin[1]
            emitted[:, :first] *= beta[:, :first]
            if t0:
                moves += before[:, :first] @ emitted[:, :first].T
                after = m.move @ emitted[:, :first]
            # Steps of equally many texts follow one another at one distance.
            ends = np.flatnonzero(np.diff(self.active[t0:t1], append=0)) + 1
            for s, e in zip(np.maximum(np.concatenate([[0], ends[:-1]]), 1).tolist(), ends.tolist(), strict=True):
                if s < e:
                    n = begin[s + 1] - begin[s]
                    moves += alpha[:, begin[s - 1] : begin[s - 1] + n] @ emitted[:, begin[s] : begin[s] + n].T
                    moves += alpha[:, begin[s] : begin[e - 1]] @ emitted[:, begin[s + 1] : begin[e]].T
            alpha *= beta
            if not t0:
                starts = alpha[:, :first].sum(1, dtype=np.float64)
            symbols = self.symbols[self.begin[t0] : self.begin[t1]]
            for own, more in zip(emissions, alpha, strict=True):
                own += np.bincount(symbols, more, len(own))
            alpha = None
        return total / np.log(10), starts, moves * m.move


def groups(texts: list[np.ndarray], size: int = GROUP) -> Iterator[list[int]]:
    """Texts by length, longest first, in groups of about ``size`` tokens."""
    part, fill = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if part and fill + len(texts[i]) > size:
            yield part
            part, fill = [], 0
        part.append(i)
        fill += len(texts[i])
    if part:
        yield part


def estimated(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, unigram: np.ndarray, prior: float = PRIOR) -> Model:
    """The model that expected counts give; emissions (symbol by state) are smoothed by ``prior`` counts of the unigram distribution."""
    start = (starts + 0.1) / (starts + 0.1).sum()
    move = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
    emit = emissions + prior * unigram[:, None]
    return Model(start, move, emit / emit.sum(0))


def gathered(texts: list[np.ndarray], m: Model, group: int | None = None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over texts: (log10 likelihood, starts, moves, emissions by symbol)."""
    total, starts, moves, emissions = 0.0, np.zeros(m.start.shape), np.zeros(m.move.shape), np.zeros(m.emit.shape[::-1])
    for part in groups(texts, group or GROUP):
        one, s, v = Batch([texts[i] for i in part]).counts(m, emissions, group)
        total, starts, moves = total + one, starts + s, moves + v
    return total, starts, moves, emissions.T


def likelihood(texts: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 likelihood of each text."""
    fit = np.zeros(len(texts))
    for part in groups(texts):
        fit[part] = Batch([texts[i] for i in part]).forward(m)[0]
    return fit


def first_model(together: np.ndarray | list, unigram: np.ndarray, states: int = STATES, rounds: int = 30) -> Model:
    """Where training begins: a state for each cluster of frequent symbols that stand together.

    ``together[i, j]`` is how many spans of all training texts hold both symbols
    i and j. Their positive pointwise mutual information with all others makes
    symbols comparable; clusters begin with the symbol farthest from those
    before and settle by spherical k-means. A symbol's probability in a state
    is its unigram share times how near it is to the state's cluster; all other
    symbols are alike in all states. Without counts all states are alike.
    """
    share = np.full((len(unigram), states), 1 / states)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    together = np.asarray(together, float) if len(together) else np.zeros((0, 0))
    often = np.diag(together)
    used = np.flatnonzero(often > 0)
    if len(used) > states:
        both = together[np.ix_(used, used)] * (1 - np.eye(len(used)))
        mass = both.sum(1) + 0.5 * len(used)
        near = np.maximum(np.log((both + 0.5) * (mass.sum() / np.outer(mass, mass))), 0) * (1 - np.eye(len(used)))
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
        weight = np.sqrt(often[used])
        centre = near[[np.argmax(weight)]]
        while len(centre) < states:
            centre = np.vstack([centre, near[np.argmax(weight * (1 - (centre @ near.T).max(0)))]])
        for _ in range(rounds):
            of = np.argmax(centre @ near.T, axis=0)
            for k in range(states):
                mid = weight[of == k] @ near[of == k]
                if (long := np.linalg.norm(mid)) > 0:
                    centre[k] = mid / long
        fit = centre @ near.T
        fit = np.exp(6 * (fit - fit.max(0)))
        share[used] = 0.1 / states + 0.9 * (fit / fit.sum(0)).T
    emit = unigram[:, None] * share
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts; the number of texts stands under the null word."""
    found: Counter[bytes] = Counter()
    texts = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column(0):
            found.update(words_of(t.as_py()))
            if len(found) > 400_000:
                yield out()
                found.clear()
        texts += b.num_rows
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])


def most_frequent(words: DataFrame, most: int) -> pa.Table:
    """The words of the highest counts, ``most`` at most, in no order.

    Counts are told apart by 64 steps to a doubling (up to 90 exactly), so the
    driver gets a histogram of a few thousand rows, then only the words it takes.
    """
    step = F.floor(F.log2("n") * 64)
    cut, taken = None, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        taken += r["n"]
        if taken > most:
            break
        cut = r["step"]
    return words.where(F.lit(False) if cut is None else step >= cut).select("word", "class", "n").toArrow()


def vocabulary(train: DataFrame, head: int = HEAD, known: int = KNOWN) -> tuple[Vocabulary, DataFrame]:
    """Counts over all training texts (column ``text``, binary): the bounded vocabulary and the table of all words."""
    counts = saved(train.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).select("word", classes("word").alias("class"), "n"), "counts")
    ends = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    words = counts.where("word is not null")
    top = most_frequent(words, known).sort_by([("n", "descending"), ("word", "ascending")])
    names, kinds, uses = (top[c].to_pylist() for c in ("word", "class", "n"))
    totals = {r["class"]: (r["n"], r["v"]) for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, distinct = sum(n for n, _ in totals.values()) + ends, sum(v for _, v in totals.values()) + (ends > 0)
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, (a, b) in totals.items():
        n[c], v[c] = a, b
    for c, a in zip(kinds[:head], uses[:head], strict=True):
        n[c] -= a
        v[c] -= 1
    number = {w: k + 1 for k, w in enumerate(names[:head])}
    unigram = np.concatenate([[ends], uses[:head], n]) + 1.0
    codes = np.array([*range(1, len(number) + 1), *(len(number) + 1 + c for c in kinds[head:])], np.int32)
    return Vocabulary(number, dict(zip(names, uses, strict=True)), ends, tokens, distinct, np.log10(n + v + 1), unigram / unigram.sum(), codes), words


def _together(code: type):
    """How many spans of a partition's texts hold two of the most frequent symbols, the end of a text aside: i, j (i <= j), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((MARKS, MARKS))
        for b in batches:
            rows: list[np.ndarray] = []
            spans = 0

            def add(rows: list[np.ndarray], spans: int) -> None:
                has = np.zeros((spans, MARKS), np.float32)
                at = np.concatenate(rows)
                has[at >> 16, at & 0xFFFF] = 1
                total[:] += has.T @ has

            for t in b.column(0):
                s = np.frombuffer(t.as_buffer(), code)
                for k in range(0, len(s), SPAN * 4096):
                    part = s[k : k + SPAN * 4096].astype(np.int64)
                    where = np.flatnonzero((part < MARKS) & (part > 0))
                    rows.append((spans + where // SPAN) << 16 | part[where])
                    spans += -(-len(part) // SPAN)
                    if spans > 8192:
                        add(rows, spans)
                        rows, spans = [], 0
            if spans:
                add(rows, spans)
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    return run


def _expected(vocab, model):
    """Baum-Welch counts of a partition and of either part: a row for each symbol, and rows -1 - k for the moves from state k and -1 - states for the starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocab.value, model.value.single()
        states = len(m.start)
        found: dict[bool, list[np.ndarray]] = {}
        for b in batches:
            texts: dict[bool, list[np.ndarray]] = {}
            for t, part in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                texts.setdefault(part, []).append(np.frombuffer(t.as_buffer(), v.code))
            for part, some in texts.items():
                sums = found.setdefault(part, [np.zeros(m.start.shape), np.zeros(m.move.shape), np.zeros(m.emit.shape)])
                for total, more in zip(sums, gathered(some, m)[1:], strict=True):
                    total += more
        for part, (starts, moves, emissions) in found.items():
            used = np.flatnonzero(emissions.sum(1) > 0)
            rows = np.concatenate([starts[None], moves, emissions[used]])
            number = np.concatenate([[-1 - states], -1 - np.arange(states), used])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(number)), pa.array(number.astype(np.int64)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states))], names=["part", "symbol", *(f"s{k}" for k in range(states))])

    return run


def _summed(rows: pa.Table, part: bool, names: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, moves and emissions from the summed rows of one part."""
    rows = rows.filter(pc.equal(rows["part"], part))
    states = len(names)
    at, x = rows["symbol"].to_numpy(), np.stack([rows[n].to_numpy() for n in names], 1).reshape(-1, states)
    moves, emissions = np.zeros((states, states)), np.zeros((symbols, states))
    is_move = (at < 0) & (at >= -states)
    emissions[at[at >= 0]] = x[at >= 0]
    moves[-1 - at[is_move]] = x[is_move]
    return x[at == -1 - states].sum(0), moves, emissions


def trained(train: DataFrame, vocab: Vocabulary, held, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all rows of ``train`` (``doc_id``, ``symbols``): each pass sums the counts of all partitions by symbol.

    The start comes from counts over all rows too. The last pass keeps one
    document in ``PART`` apart: on these, models from the counts of the others
    are compared, one for each of ``PRIORS``; the best prior makes the final
    model from all counts.
    """
    sc, size = train.sparkSession.sparkContext, len(vocab.unigram)
    together = np.zeros((MARKS, MARKS))
    pairs = train.select("symbols").mapInArrow(_together(vocab.code), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    together[pairs["i"].to_numpy(), pairs["j"].to_numpy()] = pairs["n"].to_numpy()
    together = together + np.triu(together, 1).T
    model, names = first_model(together[:size, :size], vocab.unigram, states), [f"s{k}" for k in range(states)]
    apart = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0, F.lit(False))
    for k in range(passes):
        now = sc.broadcast(model)
        part = (apart if k == passes - 1 else F.lit(False)).alias("part")
        rows = train.select("symbols", part).mapInArrow(_expected(held, now), "part boolean, symbol long, " + ", ".join(f"{n} double" for n in names)).groupBy("part", "symbol").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        most, rest = _summed(rows, False, names, size), _summed(rows, True, names, size)
        every = [a + b for a, b in zip(most, rest, strict=True)]
        model = estimated(*every, vocab.unigram)
        now.unpersist()
    if passes and rest[2].any() and most[2].any():
        model = estimated(*every, vocab.unigram, _best_prior(train.where(apart), most, rest[2].sum(1), vocab))
    return model


def _best_prior(rows: DataFrame, counts: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray, vocab: Vocabulary) -> float:
    """The prior under which a model from ``counts`` gives ``rows`` the highest likelihood; ``own`` are the rows' symbols, which its unigrams lack."""
    n = np.maximum(vocab.unigram * (vocab.tokens + len(vocab.unigram)) - own, 1.0)
    held, code = rows.sparkSession.sparkContext.broadcast((counts, n / n.sum())), vocab.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, unigram = held.value
        fit = np.zeros(len(PRIORS))
        models = None
        for b in batches:
            models = models or [estimated(*counts, unigram, p) for p in PRIORS]
            texts = [np.frombuffer(t.as_buffer(), code) for t in b.column(0)]
            fit += [likelihood(texts, m).sum() for m in models]
        yield pa.RecordBatch.from_arrays([pa.array(PRIORS), pa.array(fit)], names=["prior", "fit"])

    found = {r["prior"]: r["fit"] for r in rows.select("symbols").mapInArrow(run, "prior double, fit double").groupBy("prior").agg(F.sum("fit").alias("fit")).collect()}
    held.unpersist()
    return max(PRIORS, key=lambda p: (found.get(p, 0.0), p))


def _encoded(vocab):
    """Each text as symbols, with what the known words alone give: so texts are taken apart once, not in every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocab.value
        row, base = TaskContext.get().partitionId() << 36, len(v.number) + 1
        # Known words by number; the last entry of the arrays, -1, stands for all others.
        place = dict(zip(v.count, range(len(v.count)), strict=True)).get
        codes, logs_of = np.append(v.codes, 0), np.log10(np.append(np.fromiter(v.count.values(), np.float64, len(v.count)), 0.0) + 1.0)
        log_end = float(np.log10(v.ends + 1))
        for big in batches:
            for k in range(0, big.num_rows, 2000):
                b = big.slice(k, 2000)
                symbols, lengths, known, found, own, tails = [], [], [], [], [], []
                for t in b.column(1):
                    ws = words_of(t.as_py())
                    at = np.fromiter(map(place, ws, repeat(-1)), np.int64, len(ws))
                    s, rare = np.append(codes[at], 0), np.flatnonzero(at < 0)
                    s[rare] = [base + class_of(ws[i]) for i in rare]
                    outside = s[:-1] >= base
                    logs = logs_of[at]
                    symbols.append(s.astype(v.code).tobytes())
                    lengths.append(len(s))
                    found.append(len(ws) - len(rare) + (v.ends > 0))
                    known.append(float(logs.sum()) + log_end)
                    own.append(float(logs[outside].sum() - v.class_log[s[:-1][outside] - base].sum()))
                    tails.append([ws[i] for i in rare])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + b.num_rows), pa.int64()), b.column(0), b.column(2), pa.array(lengths, pa.int64()), pa.array(found, pa.int64()), pa.array(known, pa.float64()), pa.array(own, pa.float64()), pa.array(tails, pa.list_(pa.binary())), pa.array(symbols, pa.binary())],
                    names=["row", "doc_id", "held_out", "n_tokens", "found", "logs", "own", "tail", "symbols"],
                )
                row += b.num_rows

    return run


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each text (``row``) has each word of its ``tail``; a text is whole in one row, so nothing has to be brought together."""
    for b in batches:
        tail = b.column(1)
        words = tail.flatten().dictionary_encode()
        text = np.repeat(np.arange(b.num_rows), tail.value_lengths().to_numpy())
        pair, n = np.unique(text << 32 | words.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair >> 32)), words.dictionary.take(pa.array(pair & 0xFFFFFFFF)), pa.array(n)], names=["row", "word", "k"])


def scored(docs: DataFrame, held_out: str = "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2", states: int = STATES, passes: int = PASSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every text by the unigram base and by the model, both learned from rows that ``held_out`` does not name.

    ``held_out`` is SQL over ``doc_id``; a null id counts as not held out. A
    null text is empty: one token, its end. Repeated rows count and are scored
    each; other columns are ignored; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    vocab, words = vocabulary(rows.where("not held_out"))
    shared = sc.broadcast(vocab)
    made = saved(rows.select("doc_id", "text", "held_out").mapInArrow(_encoded(shared), "row long, doc_id long, held_out boolean, n_tokens long, found long, logs double, own double, tail array<binary>, symbols binary"), "encoded")
    model, code = sc.broadcast(trained(made.where("not held_out"), vocab, shared, states, passes)), vocab.code
    rest = ["row", "doc_id", "held_out", "n_tokens", "found", "logs", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 2000):
                b = big.slice(k, 2000)
                texts = [np.frombuffer(t.as_buffer(), code) for t in b.column(0)]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(likelihood(texts, model.value))], names=[*rest, "fit"])

    fits = made.select("symbols", *rest).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, found long, logs double, own double, fit double")
    tail = made.select("row", "tail").mapInArrow(_tails, "row long, word binary, k long")
    more = tail.join(words.select("word", "n"), "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("add"))
    both = fits.join(more, "row", "left").fillna(0, ["more"]).fillna(0.0, ["add"])
    return both.select("doc_id", "held_out", "n_tokens", (F.col("found") + F.col("more")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("logs") + F.col("add") - F.col("n_tokens") * F.lit(float(np.log10(vocab.tokens + vocab.distinct + 1)))).alias("base_score"), (F.col("fit") + F.col("own") + F.col("add")).alias("score"))
