"""SentencePiece pieces, periodic runs and collocations: against the library and brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tentpole.llm import collocations, periodic, pieces, queries
from tests.oracle import rows_of_frame, rows_of_sql

SCHEMA = "doc_id long, text string, lang string, ids string, word string, n long, phrase string"
SF = "/root/testdata/sf0.001"


def table(spark, rows, parts=3):
    """Rows of (doc_id, text, lang), with further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "i", "w", 3, "p") for r in rows], SCHEMA).repartition(parts)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())


def odd_texts(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("ab  \n\tétheing3漢🙂́\x00▁<0x>9.ß") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_the_library_s(library):
    of = pieces.pieces(queries.piece_file())
    for text in ["x" * 5000, "ab" * 4000, " " * 700, "\n\n" * 40, "漢字かな" * 300, "A sentence, as it stands. " * 400, *odd_texts(800)]:
        ids = list(of.encode(text))
        assert ids == library.encode(text)
        assert of.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    of, rng = pieces.pieces(queries.piece_file()), random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(262)]) for _ in range(rng.randrange(8))]
        assert of.decode(ids) == library.decode(ids)


def test_a_small_memory_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 50)
    monkeypatch.setattr(pieces, "STRETCHES", 20)
    of = pieces.Pieces(queries.piece_file())
    for text in odd_texts(200, 6):
        assert list(of.encode(text)) == library.encode(text)
    assert len(of.known) <= 20


def test_without_cuts_the_table_spans_the_whole_text(library):
    of = pieces.Pieces(queries.piece_file())
    of.cut = None
    for text in odd_texts(200, 7):
        assert list(of.encode(text)) == library.encode(text)


def test_models_of_other_kinds_are_refused(tmp_path):
    with pytest.raises(Exception):  # noqa: B017  the library's own error
        pieces.Pieces(str(tmp_path / "none.model"))


def test_pieces_of_odd_rows(spark, library):
    rows = [(1, None, "en"), (2, "", "en"), (2, "", "en"), (None, "of no id", None), (-4, "two  blanks ", "de"), (5, "word " * 30_000, "en")]
    got = pieces.decoded(pieces.encoded(table(spark, rows), queries.piece_file()), queries.piece_file())
    assert sorted(((r.doc_id or 0, list(r.ids), r.text) for r in got.collect())) == sorted((d or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t, _ in rows)
    assert pieces.encoded(table(spark, [], 1), queries.piece_file()).count() == 0
    assert pieces.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), queries.piece_file()).first().text == ""


def test_op11_against_the_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs:
        ids = library.encode(t or "")
        assert got[d] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def all_runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Every period against every place, without a grid or suffixes."""
    of = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes, n, smallest = np.array([of[w] for w in words], np.int64), len(words), {}
    for p in range(1, n // times + 1):
        same = np.r_[0, (codes[:-p] == codes[p:]).astype(int), 0]
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if b - a + p >= times * p:
                smallest.setdefault((int(a), int(b - a + p)), p)
    return sorted(((s, n, p) for (s, n), p in smallest.items() if n >= max(least, times * p)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 3), (2, 2), (24, 5)])
def test_runs_against_every_period(least, times):
    rng, texts = random.Random(least + times), [[], [1], [1] * 400, [1, 2] * 90 + [3] + [1, 2] * 90, [1, 1, 2] * 8]
    for _ in range(250):
        n, k = rng.randrange(150), rng.choice([1, 2, 3, 30])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 11)
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        texts.append(w)
    assert periodic.runs_of(texts, least, times) == [all_runs(w, least, times) for w in texts]


def test_grid_blocks_do_not_change_the_runs(monkeypatch):
    rng = random.Random(8)
    texts = [[rng.randrange(2) for _ in range(rng.randrange(200))] for _ in range(40)]
    whole = periodic.runs_of(texts, 6, 3)
    monkeypatch.setattr(periodic, "PLACES", 37)
    assert periodic.runs_of(texts, 6, 3) == whole


def test_common_extensions_of_suffixes():
    rng = random.Random(9)
    codes = np.array([rng.randrange(2) for _ in range(300)])
    s, plain = periodic.Suffixes(codes), codes.tolist()
    pairs = [(i, j) for i in range(-1, 301, 7) for j in range(-1, 301, 5) if i != j]
    got = s.common(*np.array(pairs).T)
    for (i, j), n in zip(pairs, got, strict=True):
        k = 0
        while min(i, j) >= 0 and max(i, j) + k < 300 and plain[i + k] == plain[j + k]:
            k += 1
        assert n == k


def test_runs_of_odd_rows(spark):
    long = "w " * 70_000
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\x0b ", "en"), (4, "a b\x0cc " * 8, "en"), (4, "a b\x0cc " * 8, "en"), (None, "x " * 30, None), (5, long, "en"), (6, "a b c " * 7 + "a b", "en")]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(table(spark, rows)).collect())
    assert got == [
        (0, 30, [(0, 30, 1)], "x"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 24, [(0, 24, 3)], "a b c"), (4, 24, [(0, 24, 3)], "a b c"),
        (5, 70_000, [(0, 70_000, 1)], "w"), (6, 23, [], "a b c a b c a b c a b c a b c a b c a b c a b"),
    ]
    assert periodic.periodic_runs(table(spark, [], 1)).count() == 0


def test_op12_against_every_period(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs, with_runs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), 0
    assert len(got) == len(docs)
    for d, t in docs:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        with_runs += bool(runs)
        gone = {i for s, n_, p in runs for i in range(s + p, s + n_)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        assert got[d] == (len(runs), *tail, sha("".join(f"{s},{n_},{p}\n" for s, n_, p in runs)), sha(kept))
    assert with_runs >= 10


def all_collocations(rows: list[tuple], support: int, longest: int, top: int) -> list[tuple]:
    """Every phrase counted, by the words of the contract."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        able = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in able.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -score) for i, (score, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def phrase_rows(n: int = 60) -> list[tuple]:
    rng = random.Random(11)
    words = "The the New york straße ÉTÉ x1 a of".split()
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\x0b", ",", "\n", "\xa0"]) for _ in range(rng.randrange(80))), rng.choice(["en", "de", None, "und", ""])) for i in range(n)]
    return [*rows, *rows[:5], (None, "no id at all", "en"), (1, None, "en"), (2, "", None), (3, "...", "fr"), (4, "over and over " * 9000, "de")]


@pytest.mark.parametrize(("support", "longest", "top"), [(3, 5, 2000), (2, 3, 7), (12, 2, 3)])
def test_collocations_against_all_phrases(spark, support, longest, top):
    got = collocations.collocations(table(spark, phrase_rows()), support, longest, top, bits=15)
    assert sorted(map(tuple, got.collect())) == all_collocations(phrase_rows(), support, longest, top)


def test_small_chunks_and_hashes_that_meet_change_nothing(spark, monkeypatch):
    rows = phrase_rows(25)[:30]
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "word_hashes", lambda words: np.zeros(len(words), np.uint64))
    words = collocations.Words(pa.array(["a b a b c", "a b"]), pa.array(["en", "de"]))
    at = np.flatnonzero(words.starts(2))
    found = words.counted(at, np.zeros(len(at), np.uint64), 2)
    assert sorted(zip(*(c.to_pylist() for c in found.columns[:4]), strict=True)) == [("de", "a b", 0, 1), ("en", "a b", 0, 2), ("en", "b a", 0, 1), ("en", "b c", 0, 1)]
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), 2, 5, 50).collect())) == all_collocations(rows, 2, 5, 50)


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 4_000_000_000_000
    rows = [("en", "", 0, 5 * big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big + 1)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, k int, f long"))
    assert tuple(collocations.collocations(None).first()) == ("en", 1, "a b", big + 1, 3 * big, 2 * big, 5 * big, 1000 * (big + 1) * 5 * big // (6 * big * big))


def test_no_collocations_of_an_empty_table(spark):
    assert collocations.collocations(table(spark, [], 1)).count() == 0
    assert collocations.collocations(table(spark, [(1, "", "en"), (2, None, None)], 1)).count() == 0


def test_op13_gives_the_rows_of_its_sql(spark):
    ours, theirs = rows_of_frame(queries.op13_collocations(spark, SF)), rows_of_sql(queries.SQL["op13_collocations"], SF)
    assert ours == theirs
    assert len(ours[1]) > 20
