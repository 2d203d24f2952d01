"""Packing, substring removal, quality rules, near-duplicates: against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tentpole.llm import common, packing, quality, queries, simhash, substring

SCHEMA = "doc_id long, text string, key long, cell string, source string, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta éta zeta theta iota kappa lambda mu nu xi omicron pi rho".split()) + str(rng.randrange(60)) for _ in range(n))


def rows() -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, copies, near copies, shared passages, a long text, other white space."""
    shared, long = prose(1, 60), prose(2, 6000)
    texts = [None, "", " \n\t ", "one", "one two three", prose(3, 80), prose(3, 80), prose(3, 80) + " more", shared + " " + prose(4, 30), prose(5, 40) + "\n" + shared, long, long.upper(), "a " * 300, "x y z w", prose(6, 49), prose(7, 50), prose(7, 50) + " z"]
    out = [(i, t, i % 3, "c", "s", 7) for i, t in enumerate(texts)]
    return [*out, out[5], (None, prose(8, 90), 1, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables_give_no_rows(nothing):
    assert packing.packed(nothing, queries.tokenizer_file()).count() == 0
    assert substring.summary(nothing).count() == 0
    assert quality.scored(nothing).count() == 0
    assert quality.filtered(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.deduplicated(nothing).count() == 0
    assert substring.removed(nothing).count() == 0


def test_packing_keeps_every_token_once(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    expected = Counter()
    for i, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        expected[i, len(ids)] += 1
    found = packing.packed(docs, queries.tokenizer_file()).collect()
    whole = Counter()
    for r in found:
        whole[r.doc_id, r.doc_tokens] += r.length
    assert whole == Counter({k: k[1] * n for k, n in expected.items()})
    ids = np.array(t.encode(rows()[10][1], add_special_tokens=False).ids + [0], "<u4")
    for r in (r for r in found if r.doc_id == 10):
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by: dict = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_tokens_equal_the_tokenizer_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    encode = packing.encoding(queries.tokenizer_file())
    for text in ["", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\n\n <|endoftext|><|endoftext|>  y  ", "<|endoftext", "Hello  world's\n\n  it's ", "Ünïcode ßtraße 日本語 emoji 🎪🎟", "<|endoftext|> x", "a" * 5000, "\u0000\r\n\t end ", "1234567890" * 3, "ÉAU!! ###$$$ é̀"]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_takes_added_tokens_as_the_file_does(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    texts = ["<|endoftext|>", "end <|endoftext|> start  <|endoftext|>\n", "<|endoftext|>" * 1500]
    for r in packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_file()).collect():
        ids = np.array(t.encode(texts[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_places_are_those_of_least_sum_of_squares():
    """Each choice of ``Levels`` against the sum of squared counts of all levels, tried one by one."""
    rng, size = random.Random(8), 12
    levels, fill, made = packing.Levels(size), Counter(), 0
    for _ in range(4000):
        s = rng.randrange(1, size + 1)

        def total(at, s=s):
            after = fill.copy()
            after[at] -= at > 0
            after[at + s] += at + s < size
            return sum(n * n for level, n in after.items() if 0 < level < size)

        options = [0] + [f for f in range(1, size - s + 1) if fill[f]]
        best = min(total(f) for f in options)
        window, at = levels.place(s)
        assert at == max(f for f in options if total(f) == best)
        fill[at] -= at > 0
        fill[at + s] += at + s < size
        made += window is None
        levels.keep(made if window is None else window, at + s)


def test_levels_fill_windows():
    rng = random.Random(5)
    lengths = [rng.randrange(0, 3000) if rng.random() < 0.3 else rng.randrange(1, 700) for _ in range(3000)]
    pieces = list(packing.pack(iter(lengths)))
    got = Counter()
    fill: dict[int, int] = Counter()
    for doc, _, n, sequence, _ in pieces:
        got[doc] += n
        fill[sequence] += n
    assert got == Counter({d: n for d, n in enumerate(lengths) if n})
    assert max(fill) < 2 * len(fill)
    assert sum(f != 1024 for f in fill.values()) <= 10
    cut = Counter(doc for doc, _, n, *_ in pieces if lengths[doc] <= 1024)
    assert sum(n > 1 for n in cut.values()) < 0.1 * len(lengths)


def brute_spans(table: list[tuple], window: int) -> dict:
    first: dict = {}
    for i, text, *_ in table:
        if i is not None:
            w = WORD.findall(text or "")
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, text, *_ in table:
        w, gone = WORD.findall(text or ""), set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out[i, text] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_substring_equals_brute_force(docs, monkeypatch, heavy):
    monkeypatch.setattr(substring, "HEAVY_ROWS", heavy)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.summary(docs).collect())
    expected = brute_spans(rows(), 50)
    assert got == Counter((i, *expected[i, t]) for i, t, *_ in rows())
    assert any(r[2] for r in got)


def test_removed_texts_are_the_kept_words(docs):
    kept = {(i, t): n for (i, t), n in brute_spans(rows(), 50).items()}
    got = Counter((r.doc_id, None if r.text is None else hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest()) for r in substring.removed(docs).collect())
    assert got == Counter((i, None if t is None else kept[i, t][2]) for i, t, *_ in rows())


def test_quality_counts_and_verdicts(docs):
    def brute(text):
        w = WORD.findall(text or "")
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if n[g] > 1:
                covered.update((k, k + 1, k + 2))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = quality.scored(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute(t)) for i, t, *_ in rows())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Counter(r.doc_id for r in quality.filtered(docs).collect()) == Counter(r.doc_id for r in got if r.kept)


def test_rule_order_does_not_change_the_verdict():
    texts = [t or "" for _, t, *_ in rows()] + ["AB CD " * 40, "x # y $ z & " * 30, "line\nline\nline\n" * 30]
    for t in texts:
        d = quality.Text(t)
        assert (quality.cascade(d, quality.RULES) is None) == (quality.cascade(quality.Text(t), quality.RULES[::-1]) is None)


def test_rules_are_ordered_by_what_is_left_to_reject():
    """A costly rule goes behind a cheap one that rejects the same, however much it would reject alone."""
    def costly(d):
        sum(x * x for x in range(20_000))
        return d.get("n_words") < 50

    some = [quality.Rule("costly", costly), quality.Rule("other", lambda d: "#" in d.text), *quality.BASE]
    texts = ["few words"] * 30 + [prose(k, 80) + " #" for k in range(10)] + [prose(k, 80) for k in range(10)]
    order = quality.greedy_order(texts, some)
    names = [n for n, *_ in order]
    assert names.index("few_words") < names.index("costly") and names[-1] == "costly"
    at = {n: (rejected, seen) for n, _, rejected, seen in order}
    assert at["costly"][0] == 0 and sum(r for r, _ in at.values()) == 40


def test_upper_case_letters_are_those_of_their_category():
    import unicodedata

    text = "".join(chr(c) for c in range(0x20, 0x1FFFF) if unicodedata.category(chr(c)) != "Cs")
    assert quality.Text(text).get("n_upper") == sum(unicodedata.category(c) == "Lu" for c in text)
    assert quality.Text(text).get("n_letters") == sum(unicodedata.category(c)[0] == "L" for c in text)


def brute_fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cell", [20_000, 3])
def test_simhash_equals_brute_force(docs, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    table = rows()
    prints = [brute_fingerprint(t) for _, t, *_ in table]
    label = list(range(len(table)))
    for _ in table:
        for a in range(len(table)):
            for b in range(len(table)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    low = {}
    for k, (i, *_) in enumerate(table):
        if i is not None:
            low[label[k]] = min(low.get(label[k], i), i)
    expected = Counter((i, f"{prints[k]:016x}", low.get(label[k])) for k, (i, *_) in enumerate(table))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == expected


def test_anchors_cover_every_neighbour():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 23, 400)
    which, anchor, home = simhash.anchors(points, 1)
    assert home.sum() == 400
    reach: dict = {}
    for w, a in zip(which.tolist(), anchor.tolist(), strict=True):
        reach.setdefault(w, set()).add(a)
    at_home = dict(zip(which[home].tolist(), anchor[home].tolist(), strict=True))
    near, _, _ = simhash.anchors(points ^ (1 << rng.integers(0, 23, 400)), 1)
    moved = points ^ (1 << rng.integers(0, 23, 400))
    w2, a2, h2 = simhash.anchors(moved, 1)
    homes = dict(zip(w2[h2].tolist(), a2[h2].tolist(), strict=True))
    assert all(homes[k] in reach[k] for k in range(400))
    assert len(near) and len(at_home) == 400


def test_random_close_fingerprints_are_all_linked():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        met = False
        for first, bits in simhash.FOUR_BITS.segments:
            p, q = (np.array([(v >> first) & ((1 << bits) - 1)]) for v in (x, y))
            w, a, h = simhash.anchors(p, 1)
            met |= int(simhash.anchors(q, 1)[1][simhash.anchors(q, 1)[2]][0]) in a.tolist()
        assert met


def test_similar_texts_are_merged_and_others_kept(spark):
    table, rng = [], random.Random(3)
    for k in range(40):
        words = prose(100 + k, 200).split()
        table.append((3 * k, " ".join(words)))
        edited = list(words)
        edited[rng.randrange(200)] = "changed"
        edited[rng.randrange(200)] = "again"
        table += [(3 * k + 1, " ".join(edited)), (3 * k + 2, prose(500 + k, 120))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert {3 * k for k in range(40)} | {3 * k + 2 for k in range(40)} <= kept
    assert len(kept & {3 * k + 1 for k in range(40)}) <= 1


@pytest.mark.parametrize("links", [common.LINKS, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, links):
    monkeypatch.setattr(common, "LINKS", links)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (201, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {k: 0 for k in range(1, 61)} | {100 + k: 100 for k in range(1, 50)} | {201: 200}
    assert {n: c for n, c in got.items() if n != c} == expected


def test_lookup_join_with_a_heavy_key(spark):
    rows_ = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(300)], "key long, v long")
    table = spark.createDataFrame([(1, "a"), (3, "b")], "key long, name string")
    plain = Counter(map(tuple, rows_.join(table, "key", "left").collect()))
    assert Counter(map(tuple, common.lookup_join(rows_, table, "key", "left", [1]).collect())) == plain
    assert common.heavy_keys(rows_, "key", share=0.5, least=10) == [1]


def with_similarity(percent: int, k: int, n: int = 180) -> tuple[str, str]:
    """Two texts of words that occur once, whose sets of five-word shingles have about that similarity; the tail differs."""
    same = round(2 * n * percent / (100 + percent))
    left, right = ([f"w{k}x{i}" for i in range(same + 4)] + [f"{side}{k}x{i}" for i in range(n - same)] for side in "ab")
    return " ".join(left), " ".join(right)


@pytest.mark.parametrize("part", [simhash.PART, 500])
def test_near_duplicates_are_those_with_similar_sets_of_shingles(spark, monkeypatch, part):
    """Pairs at 0.70, 0.78, 0.80 and 0.85: the first two never, the others always; a chain links its ends."""
    monkeypatch.setattr(simhash, "PART", part)
    table, linked = [], {}
    for at, percent in enumerate((70, 78, 80, 85)):
        for k in range(60):
            i = 1000 * at + 2 * k
            a, b = with_similarity(percent, 100 * at + k)
            x, y = ({tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in (a, b))
            linked[i] = len(x & y) >= 0.8 * len(x | y)
            table += [(i, a), (i + 1, b)]
        assert {linked[i] for i in range(1000 * at, 1000 * at + 120, 2)} == {percent >= 80}
    base = [f"c{i}" for i in range(200)]
    table += [(9000 + k, " ".join(base[10 * k :] + [f"d{i}" for i in range(10 * k)])) for k in range(8)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(3), simhash.SIMILAR).collect()}
    assert len(got) == len(table)
    assert {i: got[i] == got[i + 1] for i in linked} == linked
    assert {got[9000 + k] for k in range(8)} == {9000}


def test_similar_sets_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sets = [np.unique(rng.choice(14, rng.integers(1, 13)).astype(np.uint64)) for _ in range(25)]
        expected = list(range(25))
        for i in range(25):
            for j in range(i):
                if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                    expected = [expected[j] if e == expected[i] else e for e in expected]
        got = simhash.similar_sets(sets, 80)
        assert len({*zip(expected, got.tolist(), strict=True)}) == len(set(expected)) == len(set(got.tolist()))


def test_rows_with_one_id_and_unlike_texts_stay(spark):
    near = prose(900, 200)
    table = [(1, prose(901, 100)), (1, prose(902, 100)), (1, prose(902, 100)), (2, near), (2, near + " more"), (3, near + " again"), (None, near)]
    got = simhash.deduplicated(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == {1: 2, 2: 1, None: 1}
    assert {r.text for r in got if r.doc_id == 1} == {prose(901, 100), prose(902, 100)}
