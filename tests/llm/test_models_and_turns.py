"""Toxicity, decontamination, chat repair, the language model, and the pipeline."""

import heapq
import itertools
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from tentpole.llm import chat, decontaminate, hmm, queries, toxicity
from tentpole.llm import transducers as t
from tests.llm.test_text_operators import prose

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(1), [], []
    for k in range(900):
        words = prose(k, 60).split()
        toxic = k % 3 == 0
        if toxic:
            for w in rng.sample(["blorgen", "blorgish", "blorgs", "snark", "snarks"], 2):
                words.insert(rng.randrange(60), w)
        text = " ".join(words)
        docs.append((k, text, "en", "s", len(text)))
        labels.append((k, int(toxic)))
    copies = [(2000 + k, "rare unseen words of one copied text " + prose(9999, 40), "en", "s", 1) for k in range(40)]
    labels += [(d, 1) for d, *_ in copies]
    docs += [*copies, (5000, None, None, None, None), (None, "snark blorgen", None, None, None), (5001, "", "", "", 0), docs[0]]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic long")


def test_toxicity_is_learned_and_held_out(labelled):
    docs, labels = labelled
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for k in range(900):
        assert by[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= by[k].score <= 1 and by[k].predicted == int(by[k].score >= 0.7)
    held = [k for k in range(900) if by[k].held_out]
    assert all(by[k].predicted == int(k % 3 == 0) for k in held)
    assert by[5000].predicted == by[5001].predicted == 0 and by[None].held_out is False and by[None].predicted == 1


def test_copies_do_not_make_a_lexicon(labelled):
    docs, labels = labelled
    lexicon = toxicity.trained(docs, labels).lexicon
    assert lexicon.weight("blorgable") > 0 and lexicon.weight("snark") > 0
    assert lexicon.weight("unseen") == lexicon.weight("copied") == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic long")
    assert [(r.predicted, r.held_out) for r in toxicity.scored(docs, none).collect()] == [(0, zlib.crc32(b"1") % 3 == 1)]
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_composed_grammar_reads_clauses():
    kinds = lambda symbols: [k for k, _ in t.grammar().run(list(symbols)) if k in toxicity.FEATURES]
    assert kinds("oio") == [t.BARE]
    assert kinds("tooi") == [t.AIMED]
    assert kinds("ni") == [t.DENIED]
    assert kinds("rooti") == [t.TOLD]
    assert kinds("hot") == [t.MENACE]
    assert kinds("nooooi") == [t.BARE]
    assert kinds("") == []


def test_composition_equals_one_after_the_other():
    parts = [t.insults(), t.threats(), t.targets(), t.negations(), t.reports()]
    rng = random.Random(4)
    for _ in range(200):
        symbols = [rng.choice("oihtnr") for _ in range(rng.randrange(12))]
        out, weight = list(symbols), 0.0
        for p in parts:
            made = p.run(out)
            out, weight = [s for s, _ in made], weight + sum(w for _, w in made)
        whole = t.grammar().run(symbols)
        assert [s for s, _ in whole] == out and math.isclose(sum(w for _, w in whole), weight)


def align(a: list, b: list) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
        h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
        best = max(best, h[i][j])
    return best


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 20))
        score, first, end = decontaminate.smith_waterman(a, b)
        assert score == align(a.tolist(), b.tolist())
        assert score == 0 or align(a.tolist(), b[first:end].tolist()) == score


def test_leaks_exact_and_edited(spark):
    rng, items = random.Random(6), [(k, prose(700 + k, 30)) for k in range(12)] + [(50, None), (51, ""), (52, "two words")]
    docs, expected = [], set()
    for k in range(12):
        words = items[k][1].split()
        edited = [w if n % 8 else "other" for n, w in enumerate(words)]
        docs += [(10 * k, " ".join([prose(k, 50), items[k][1].upper().replace(" ", ",  "), prose(k + 40, 50)])), (10 * k + 1, prose(k + 80, 20) + " " + " ".join(edited[:12] + ["inserted"] + edited[12:])), (10 * k + 2, prose(k + 120, 200)), (10 * k + 3, " ".join(words[:9]) + " " + prose(k + 160, 60))]
        expected |= {(10 * k, k), (10 * k + 1, k)}
    docs += [(900, None), (901, ""), (None, items[3][1]), docs[0]]
    rng.shuffle(docs)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected | {(None, 3)}
    assert all(0.5 <= r.score <= 1 for r in got) and sum((r.doc_id, r.item_id) == (0, 0) for r in got) == 2
    gone = {d for d, _ in expected}
    assert Counter(r.doc_id for r in decontaminate.clean(table, bench).collect()) == Counter(d for d, x in docs if d not in gone and not (d is None and x))
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(k, prose(700 + k, 30)) for k in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(k, 20) + " " + prose(700 + k, 30)) for k in range(12)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 150)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k in range(12)}


def cheapest(roles: list[str]) -> int:
    done, todo = set(), [(0, 0, "")]
    while todo:
        cost, k, state = heapq.heappop(todo)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(roles) and state in chat.FINAL and (state or not roles):
            return cost
        for x in chat.LEGAL[state]:
            heapq.heappush(todo, (cost + chat.INSERT, k, x))
        for x in chat.ROLES if k < len(roles) else ():
            more = cost + (x != roles[k]) * chat.RELABEL
            if x == state:
                heapq.heappush(todo, (more + chat.MERGE, k + 1, x))
            if x in chat.LEGAL[state]:
                heapq.heappush(todo, (more, k + 1, x))
    raise AssertionError


def test_repairs_are_legal_and_cheapest():
    for n in range(6):
        for roles in itertools.product([*chat.ROLES, "tool"], repeat=n):
            r = chat.repaired(list(roles))
            assert r.cost == cheapest(list(roles))
            state = ""
            for role, _ in r.turns:
                assert role in chat.LEGAL[state]
                state = role
            assert state in chat.FINAL and [k for _, own in r.turns for k in own] == list(range(n))


def test_conversations_with_odd_rows(spark):
    table = [(1, 0, "user", "hi", "e"), (1, 1, "assistant", "yo", "e"), (2, 0, "USER ", "a", "e"), (2, 1, "user", "b", "e"), (3, None, None, None, None), (3, 1, "assistant", "z", None), (None, 0, "user", "alone", None), (None, 0, "user", "alone", None), (None, 1, "assistant", "too", None), (4, 0, "user", "same", None), (4, 0, "user", "same", None)]
    every = chat.formatted(spark.createDataFrame(table, "conv_id long, turn long, role string, text string, edits string")).collect()
    got = {r.conv_id: r for r in every if r.conv_id is not None}
    # A turn without an id is a conversation of its own, repeated or not.
    alone = sorted((r.n_turns, r.rendered.count("alone"), r.rendered.count("too")) for r in every if r.conv_id is None)
    assert alone == [(1, 0, 1), (1, 1, 0), (1, 1, 0)]
    assert set(got) == {1, 2, 3, 4} and got[1].cost == 0 and got[1].edits == ""
    assert got[1].rendered == "<|user|>\nhi\n<|assistant|>\nyo\n"
    assert got[2].rendered == "<|user|>\na\n<|assistant|>\nb\n" and got[2].cost == chat.RELABEL
    assert got[3].n_turns == 2 and got[3].rendered.endswith("<|assistant|>\nz\n")
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(0)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 2, 4)]
    total, starts, moves, emissions = hmm.gathered(texts, m)
    likelihood, s2, m2, e2 = [], np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for x in texts:
        paths = list(itertools.product(range(3), repeat=len(x)))
        p = [m.start[q[0]] * math.prod(m.move[a, b] for a, b in zip(q, q[1:], strict=False)) * math.prod(m.emit[w, k] for w, k in zip(x, q, strict=True)) for q in paths]
        likelihood.append(math.log10(sum(p)))
        for q, w in zip(paths, p, strict=True):
            w /= sum(p)
            s2[q[0]] += w
            for a, b in zip(q, q[1:], strict=False):
                m2[a, b] += w
            for sym, k in zip(x, q, strict=True):
                e2[sym, k] += w
    assert np.allclose(hmm.Batch(texts).forward(m)[0], likelihood)
    assert math.isclose(total, sum(likelihood))
    assert np.allclose(starts, s2) and np.allclose(moves, m2) and np.allclose(emissions, e2)


@pytest.mark.parametrize("group", [1, 3, 50])
def test_counts_of_long_texts_do_not_depend_on_the_cuts(group):
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(4), 0), norm(rng.random((4, 4)), 1), norm(rng.random((9, 4)), 0))
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 300, 17, 120, 120, 2)]
    for a, b in zip(hmm.gathered(texts, m), hmm.gathered(texts, m, group), strict=True):
        assert np.allclose(a, b)


def by_rows(texts, m):
    """Expected counts of texts side by side with a row for each text and a sum of moves for each step: what counting must cost less than."""
    b, states = hmm.Batch(texts), len(m.start)
    alpha, scale, a = np.empty((len(b.symbols), states), m.emit.dtype), np.empty(len(b.symbols), m.emit.dtype), None
    steps = list(itertools.pairwise(b.begin.tolist()))
    for i, j in steps:
        a = (m.start if a is None else a[: j - i] @ m.move) * m.emit[b.symbols[i:j]]
        scale[i:j] = c = a.sum(1)
        a /= c[:, None]
        alpha[i:j] = a
    moves, beta, emissions = np.zeros((states, states)), np.ones((b.active[-1], states), m.emit.dtype), np.zeros(m.emit.shape)
    for t in range(len(steps) - 1, -1, -1):
        i, j = steps[t]
        ahead = m.emit[b.symbols[i:j]] * beta / scale[i:j, None]
        alpha[i:j] *= beta
        if t:
            h = steps[t - 1][0]
            moves += alpha[h : h + j - i].T @ ahead
            beta = np.ones((b.active[t - 1], states), m.emit.dtype)
            beta[: j - i] = ahead @ m.move.T
    used, at = np.unique(b.symbols, return_inverse=True)
    emissions[used] = np.stack([np.bincount(at, alpha[:, k], len(used)) for k in range(states)], 1)
    return alpha[: b.active[0]].sum(0), moves * m.move, emissions


def test_counting_costs_less_than_by_rows():
    """With the values of a state along memory, counts stay the same and take less time (measured on this shape: 0.52 of it)."""
    rng = np.random.default_rng(4)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(12), 0), norm(rng.random((12, 12)), 1), norm(rng.random((54_000, 12)), 0)).single()
    texts = [rng.integers(0, 54_000, n).astype(np.int32) for n in rng.integers(50, 100, 3000)]

    def cost(run):
        times = []
        for _ in range(5):
            start = time.process_time()
            out = run(texts, m)
            times.append(time.process_time() - start)
        return min(times), out

    (plain, want), (own, got) = cost(by_rows), cost(hmm.gathered)
    for a, b in zip(got[1:], want, strict=True):
        assert np.allclose(a, b, 1e-3, 1e-3)
    assert own < 0.8 * plain, (own, plain)


def test_training_over_partitions_equals_training_in_one_place(spark, monkeypatch):
    """Start, passes and the choice of the prior against the same steps over a plain list of all training texts."""
    monkeypatch.setattr(hmm, "PRIORS", (5.0, 50.0, 500.0))
    rng, texts = random.Random(11), []
    for k in range(150):
        words = "ab ac ad ae af ag ah ai aj ak".split() if k % 2 else "ba bb bc bd be bf bg bh bi bj".split()
        texts.append((k, " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(20))]) for _ in range(rng.randrange(1, 400)))))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    vocab, _ = hmm.vocabulary(rows.selectExpr("cast(text as binary) as text"))
    shared = spark.sparkContext.broadcast(vocab)
    made = rows.selectExpr("doc_id", "cast(text as binary) as text", "false as held_out").mapInArrow(hmm._encoded(shared), "row long, doc_id long, held_out boolean, n_tokens long, found long, logs double, own double, tail array<binary>, symbols binary").persist()
    got = hmm.trained(made, vocab, shared, states=3, passes=2)
    part = {r[0]: r[1] for r in rows.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {hmm.PART}) = 0").collect()}
    own = [(k, vocab.symbols(t.encode().split())) for k, t in texts]
    together = np.zeros((hmm.MARKS, hmm.MARKS))
    for _, s in own:
        for k in range(0, len(s), hmm.SPAN):
            near = {int(x) for x in s[k : k + hmm.SPAN] if 0 < x < hmm.MARKS}
            for i, j in itertools.product(near, near):
                together[i, j] += 1
    size = len(vocab.unigram)
    m = hmm.first_model(together[:size, :size], vocab.unigram, 3)
    m = hmm.estimated(*hmm.gathered([s for _, s in own], m)[1:], vocab.unigram)
    most, rest = (hmm.gathered([s for k, s in own if part[k] == x], m)[1:] for x in (False, True))
    n = vocab.unigram * (vocab.tokens + size) - rest[2].sum(1)
    fit = {p: hmm.likelihood([s for k, s in own if part[k]], hmm.estimated(*most, n / n.sum(), p)).sum() for p in hmm.PRIORS}
    best = max(fit, key=lambda p: fit[p])
    want = hmm.estimated(*(a + b for a, b in zip(most, rest, strict=True)), vocab.unigram, best)
    assert np.allclose(got.emit, want.emit, 1e-3) and np.allclose(got.move, want.move, 1e-3) and np.allclose(got.start, want.start, 1e-3)
    assert len(set(np.argmax(got.emit[[vocab.number[b"ab"], vocab.number[b"ac"]]], 1)) | set(np.argmax(got.emit[[vocab.number[b"ba"], vocab.number[b"bb"]]], 1))) > 1


@pytest.mark.parametrize("sizes", [(hmm.HEAD, hmm.KNOWN), (20, 40)])
def test_language_model(spark, monkeypatch, sizes):
    rng, docs = random.Random(2), []
    for k in range(240):
        words = ["alpha", "beta", "gamma", "delta"] if k % 2 else ["eins", "zwei", "drei", "vier"]
        docs.append((k, " ".join(rng.choice(words) + rng.choice(["", "", "", str(rng.randrange(30))]) for _ in range(40))))
    docs += [(900, None), (901, " \n"), (None, "Alpha BETA"), docs[3]]
    monkeypatch.setattr(hmm.vocabulary, "__defaults__", sizes)
    got = hmm.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), states=3).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c: Counter = Counter()
    for d, x in docs:
        if not held(d):
            c.update([*(x or "").lower().split(), ""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        tokens = [*(text[r.doc_id] or "").lower().split(), ""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    per = lambda f: sum(getattr(r, f) for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
    assert per("score") > per("base_score") + 0.1


def test_language_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(k, "a b" if k % 2 else "b c c") for k in range(30)], "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "cast(text as binary) as text")
    vocab, _ = hmm.vocabulary(rows, 2, 3)
    # Head words, ends and classes share one; within a class, known words and one unknown share one.
    m = hmm.first_model([], vocab.unigram, 2)
    assert np.allclose(m.emit.sum(0), 1) and math.isclose(vocab.unigram.sum(), 1)
    outside = [w for w in vocab.count if w not in vocab.number]
    by: dict = {}
    for w in outside:
        k = hmm.class_of(w)
        by[k] = by.get(k, 1.0) + vocab.count[w] + 1
    assert all(math.isclose(math.log10(x), vocab.class_log[k]) for k, x in by.items())


def test_words_have_one_class_in_python_and_in_spark(spark):
    words = [b"", b"a", b"ab", b"abc", b"abcd", b"a longer one", "äö€".encode(), b"\xff\x00\xfe\xfd", bytes(range(128, 160))]
    got = spark.createDataFrame([(w,) for w in words], "word binary").select("word", hmm.classes("word")).collect()
    assert [(bytes(w), k) for w, k in got] == [(w, hmm.class_of(w)) for w in words]


def test_tails_are_counted_where_they_are(spark):
    """Each text's rare words meet their counts after one shuffle by word; no other brings a text's repeats together."""
    rows = spark.createDataFrame([(7, [b"x", b"y", b"x"]), (8, []), (9, [b"y"]), (10, [b"z", b"x"])], "row long, tail array<binary>").coalesce(1)
    got = rows.mapInArrow(hmm._tails, "row long, word binary, k long")
    assert sorted((r, bytes(w), k) for r, w, k in got.collect()) == [(7, b"x", 2), (7, b"y", 1), (9, b"y", 1), (10, b"x", 1), (10, b"z", 1)]
    assert rows.where("row = 8").mapInArrow(hmm._tails, "row long, word binary, k long").count() == 0


def test_empty_language_model(spark):
    assert hmm.scored(spark.createDataFrame([], "doc_id long, text string"), states=2).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(80).withColumn("extra", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = out.collect()
        now = {r.doc_id for r in rows}
        assert now <= kept and len(rows) == len(now)
        docs, kept = spark.createDataFrame(rows, DOC), now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == kept


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def plain_lexicon(sample: list[tuple[str, int]]) -> dict[tuple[str, bool], tuple[int, int, int]]:
    """For each term of a sample: documents of either label, and how many hashed contexts it has in toxic ones."""
    found: dict = {}
    for text, toxic in sample:
        own: dict = {}
        before = ""
        for w in toxicity.WORDS.findall(text.lower()):
            for term in [(w, True)] + [(w[:n], False) for n in toxicity.BEGINNINGS if len(w) > n]:
                own.setdefault(term, set()).add(zlib.crc32(before.encode()) & 63)
            before = w
        for term, contexts in own.items():
            x = found.setdefault(term, [0, 0, set()])
            x[toxic] += 1
            x[2] |= contexts if toxic else set()
    return {k: (a, b, len(c)) for k, (a, b, c) in found.items()}


def test_toxic_scores_equal_a_plain_version(spark, labelled):
    """Each step by itself: who is learned from, terms, clauses through one transducer after the other, the fitted weights."""
    docs, labels = labelled
    own = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic in (0, 1)}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sample = {t: own[d] for d, t in rows if t is not None and d in own and zlib.crc32(str(d).encode()) % 3 != 1}
    model = toxicity.trained(docs.select("doc_id", "text"), labels)
    terms = plain_lexicon(list(sample.items()))
    n1, n0 = sum(sample.values()), len(sample) - sum(sample.values())
    odds = lambda a, b: math.log((b + 0.5) / (n1 + 1)) - math.log((a + 0.5) / (n0 + 1))
    for term, weight in [((w, True), x) for w, x in model.lexicon.words.items()] + [((w, False), x) for w, x in model.lexicon.beginnings.items()]:
        a, b, contexts = terms[term]
        assert math.isclose(weight, odds(a, b)) and b >= toxicity.LEAST_DOCS and contexts >= toxicity.CONTEXTS and weight >= toxicity.LOG_ODDS
    parts = [t.insults(), t.threats(), t.targets(), t.negations(), t.reports()]

    def plain(text: str) -> list[float]:
        counts, mass = Counter(), Counter()
        for clause in toxicity.CLAUSE.split(text.lower()):
            words = toxicity.WORDS.findall(clause)
            weights = [model.lexicon.weight(w) for w in words]
            now, paid = [t.INSULT if x else toxicity.CLASSES.get(w, t.OTHER) for w, x in zip(words, weights, strict=True)], [0.0] * len(words)
            for p in parts:
                made = p.run(now)
                now, paid = [s for s, _ in made], [a + w for a, (_, w) in zip(paid, made, strict=True)]
            # From the right: what stands alone is aimed at a target up to three words behind it.
            for k, s in enumerate(now):
                if s == t.BARE and t.TARGET in now[k + 1 : k + 4]:
                    now[k], paid[k] = t.AIMED, paid[k] + 0.5
            hit = [(max(0.0, 1 + p) * (x or 1.0), s) for s, p, x in zip(now, paid, weights, strict=True) if s in toxicity.FEATURES]
            if hit:
                counts[max(hit)[1]] += 1
                mass[max(hit)[1]] += sum(w for w, _ in hit)
        return [*(math.log1p(counts[k]) for k in toxicity.FEATURES), *(math.log1p(mass[k]) for k in toxicity.FEATURES), math.log1p(sum(counts.values()))]

    got = toxicity.scored(docs, labels).collect()
    text = dict(rows)
    for r in got:
        x = (np.array(plain(text[r.doc_id] or "")) - model.mean) / model.spread
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, float(x @ model.weights) + model.bias)))), rel_tol=1e-6)


def test_edited_copies_are_found_by_seeds(spark):
    """All documents against all items by alignment; of copies with up to a third of the words replaced, seeds find nine in ten or more."""
    rng = random.Random(12)
    items = [(k, prose(5000 + k, rng.randrange(20, 50))) for k in range(40)]
    docs = []
    for k in range(200):
        words = items[k % 40][1].split()
        changed = rng.sample(range(len(words)), int(len(words) * (k % 5) / 15))
        edited = ["x" + w if n in changed else w for n, w in enumerate(words)]
        docs.append((k, " ".join([prose(6000 + k, 60), *edited, prose(7000 + k, 60)])))
    docs += [(1000 + k, prose(9000 + k, 150)) for k in range(100)]
    held = {i: decontaminate.words_of(t) for i, t in items}
    wanted = set()
    for d, t in docs:
        words = decontaminate.words_of(t)
        for i, item in held.items():
            if decontaminate.aligned(item, words) is not None:
                wanted.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame([(*r, "a", "b", "c") for r in docs], "doc_id long, text string, item_id string, key string, row string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= wanted and len(got) >= 0.9 * len(wanted) and len(wanted) >= 190
    assert not any(d >= 1000 for d, _ in got)


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{k % 977}" for k in range(120_000))
    clash = "doc_id long, text string, row long, symbols string, held_out string, word string, n long, key long, hits string, score string"
    rows = [(1, long, *[None] * 8), (2, "short text of few words", *[1, "s", "h", "w", 1, 1, "x", "y"]), (3, None, *[None] * 8)]
    docs = spark.createDataFrame(rows, clash)
    assert {r.doc_id: r.n_tokens for r in hmm.scored(docs, states=2, passes=1).collect()} == {1: 120_001, 2: 6, 3: 1}
    labels = spark.createDataFrame([(1, 0, "t"), (2, 1, "t")], "doc_id long, toxic long, text string")
    assert toxicity.scored(docs, labels).count() == 3
    bench = spark.createDataFrame([(7, " ".join(f"word{k}" for k in range(900, 940)), 1)], "item_id long, text string, doc_id long")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 7)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    turns = spark.createDataFrame([(1, k, ["user", "assistant", "user"][k % 3], f"t{k}") for k in range(3000)], "conv_id long, turn long, role string, text string")
    assert chat.formatted(turns).first().n_turns == 3000


def plain_pipeline(docs: list[tuple], items: list[tuple]) -> dict[int, str]:
    """Texts left after rules, near-duplicates, repeated passages and leaks, by comparing all with all."""
    from tentpole.llm import quality
    from tests.llm.test_text_operators import WORD

    left = [(d, x) for d, x in docs if quality.cascade(quality.Text(x or ""), quality.RULES) is None]
    sets = [{tuple(x.lower().split()[k : k + 5]) for k in range(len(x.split()) - 4)} for _, x in left]
    label = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old = label[a]
                label = [label[b] if e == old else e for e in label]
    least: dict = {}
    for k, (d, _) in enumerate(left):
        least[label[k]] = min(least.get(label[k], d), d)
    seen, unique = set(), []
    for k, (d, x) in enumerate(left):
        if d == least[label[k]] and (d, label[k]) not in seen:
            seen.add((d, label[k]))
            unique.append((d, x))
    first: dict = {}
    for d, x in unique:
        w = WORD.findall(x)
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), d), d)
    cut = {}
    for d, x in unique:
        w, gone = WORD.findall(x), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        cut[d] = " ".join(y for k, y in enumerate(w) if k not in gone)
    held = [decontaminate.words_of(t) for _, t in items if decontaminate.words_of(t)]
    return {d: x for d, x in cut.items() if not any(decontaminate.aligned(i, decontaminate.words_of(x)) for i in held)}


def test_pipeline_run_equals_a_plain_version(spark, tmp_path):
    """``run`` over a table with nulls, empty texts, repeated rows, copies, near copies, shared passages and leaks; and over an empty one."""
    import corpus_pipeline
    from tentpole.llm import packing

    rng = random.Random(21)
    items = [(k, prose(3000 + k, 40)) for k in range(5)] + [(9, None), (10, "")]
    shared = prose(77, 60)
    docs: list[tuple] = []
    for k in range(30):
        words = prose(400 + k, 220).split()
        docs.append((10 * k, " ".join(words)))
        near = list(words)
        near[rng.randrange(220)] = "changed"
        docs += [(10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(words[:100] + prose(600 + k, 120).split()))]
    docs += [(500 + k, prose(800 + k, 90) + " " + shared + " " + prose(850 + k, 40)) for k in range(4)]
    docs += [(600 + k, prose(900 + k, 90) + " " + items[k][1] + " " + prose(950 + k, 30)) for k in range(5)]
    docs += [(700, None), (701, ""), (702, "too few words"), (703, "same " * 100), docs[0], docs[0]]
    rng.shuffle(docs)
    full = [(d, x, "en", "s", len(x or "")) for d, x in docs]
    (tmp_path / "full").mkdir()
    spark.createDataFrame(full, DOC).repartition(3).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/full/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()
    expected = plain_pipeline(docs, items)
    encode = packing.encoding(queries.tokenizer_file())
    want = {d: len(encode(x)) + 1 for d, x in expected.items()}
    placed: Counter = Counter()
    for r in got:
        placed[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert placed == Counter(want) and 40 < len(want) < 90
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def plain_alignment(a: list[str], b: list[str]) -> int:
    """The best local alignment, cell by cell: 2 a match, 1 off for a word that differs or is left out."""
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        before, best = now, max(best, *now)
    return best


def test_alignments_against_plain_cells():
    rng = random.Random(21)
    found = 0
    for _ in range(600):
        item = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))]
        window = [rng.choice("abcdefghxyz") for _ in range(rng.randrange(20))]
        if rng.random() < 0.6:
            part = [w for w in item if rng.random() > 0.25]
            at = rng.randrange(len(window) + 1)
            window = window[:at] + [w if rng.random() > 0.2 else "z" for w in part] + window[at:]
        score, got = plain_alignment(item, window), decontaminate.aligned(item, window)
        assert (got is not None) == (score >= len(item))  # half of the 2 a word that a perfect copy has
        found += got is not None
        if got:
            assert got[0] == score / (2 * len(item)) and plain_alignment(item, window[got[1] : got[2]]) == score
    assert 150 < found < 550


def rejected(text: str) -> bool:
    """Whether a document breaks a quality rule, as the rules say."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n, chars = len(words), sum(map(len, words))
    windows = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    again = {k + j for k in range(n - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    letters, upper = (sum(unicodedata.category(c) in kinds for c in text) for kinds in (("Lu", "Ll", "Lt", "Lm", "Lo"), ("Lu",)))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (
        n < 50 or 100 * len(again) > 50 * n or 100 * symbols > 5 * chars or 2 * upper > letters
        or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * n or chars > 20 * n
    )


def test_the_cascade_rejects_what_the_rules_say():
    from tentpole.llm import quality

    rng, counts = random.Random(22), Counter()
    for _ in range(500):
        word = rng.choice([lambda: "w" + str(rng.randrange(400)), lambda: rng.choice(["a", "b"]) + "x" * rng.randrange(40), lambda: rng.choice(["UP", "Low", "é", "#", "1"]) * rng.randrange(1, 4), lambda: str(rng.randrange(30))])
        text = "".join(word() + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.choice([0, 20, 49, 50, 51, 80, 200])))
        text += rng.choice(["", "", "one line\n" * 40, "#$ " * 30])
        bad = rejected(text)
        assert (quality.cascade(quality.Text(text), quality.RULES) is not None) == bad
        counts[bad] += 1
    assert min(counts.values()) > 50


def test_clauses_are_read_from_both_sides():
    read = lambda text: [kind for kind, _ in toxicity.clauses(text, lambda w: 2.0 if w == "idiot" else 0.0)]
    assert read('He said: "you are an idiot". You are an idiot') == [t.TOLD, t.AIMED]
    assert read("What an idiot, you! What an idiot. Idiot one two three four you") == [t.AIMED, t.BARE, t.BARE]
    assert read("not an idiot, you") == [t.DENIED] and read("nothing here: at all") == []
