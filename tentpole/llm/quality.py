"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
#: Documents on which cost and selectivity of the rules are estimated.
SAMPLE_DOCS = 400


@dataclass
class Text:
    """A document and what rules have computed of it so far, each at most once."""

    text: str
    known: dict = field(default_factory=dict)

    def get(self, name: str):
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]


def _repeat_words(d: Text) -> int:
    words = d.get("words")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def _dup_lines(d: Text) -> int:
    lines = [x for x in d.text.split("\n") if x and x.encode("utf-8", "surrogatepass").strip()]
    return len(lines) - len(set(lines))


#: Numerals and circled or squared letters that are upper case, but no upper-case letters (category Lu).
UPPER_BUT_NO_LETTER = re.compile("[\u2160-\u216F\u24B6-\u24CF\U0001F130-\U0001F149\U0001F150-\U0001F169\U0001F170-\U0001F189]")

#: What a rule may ask of a document. Words are runs of characters other than blank and \x09-\x0D.
MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda d: d.text.encode("utf-8", "surrogatepass").split(),
    "n_words": lambda d: len(d.get("words")),
    "word_chars": lambda d: len(d.text) - sum(map(d.text.count, " \t\n\v\f\r")),
    "n_symbols": lambda d: sum(map(d.text.count, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda d: sum(1 for x in d.text.split("\n") if x.strip(" \t\v\f\r")),
    "n_repeat_words": _repeat_words,
    "n_upper": lambda d: sum(map(str.isupper, d.text)) - (0 if d.text.isascii() else len(UPPER_BUT_NO_LETTER.findall(d.text))),
    "n_letters": lambda d: sum(map(str.isalpha, d.text)),
}


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is true for a document that must go."""

    name: str
    rejects: Callable[[Text], bool]


#: The rules that make up ``base_failed``.
BASE = [
    Rule("few_words", lambda d: d.get("n_words") < 50),
    Rule("repeated_words", lambda d: 100 * d.get("n_repeat_words") > 50 * d.get("n_words")),
]
#: What the method adds: limits far from what prose reaches.
MORE = [
    Rule("symbols", lambda d: 100 * d.get("n_symbols") > 5 * d.get("word_chars")),
    Rule("upper_case", lambda d: 2 * d.get("n_upper") > d.get("n_letters")),
    Rule("repeated_lines", lambda d: 2 * d.get("n_dup_lines") > d.get("n_lines")),
    Rule("word_length", lambda d: not 2 * d.get("n_words") <= d.get("word_chars") <= 20 * d.get("n_words")),
]
RULES = BASE + MORE


def greedy_order(texts: list[str], rules: list[Rule] = RULES) -> list[tuple[str, float, int, int]]:
    """The rules by rejections per second, each as (rule, seconds, rejected, looked at).

    The first place goes to the rule that rejects most per second of cost on
    all texts. Each next one is judged on the texts that are left then, and by
    what it costs beyond what the rules before it have already computed of
    them. Rules that reject nothing more go last, the cheaper first.
    """
    left, order, todo = [Text(t) for t in texts], [], list(rules)
    while todo:
        tried = []
        for place, rule in enumerate(todo):
            copies = [Text(d.text, dict(d.known)) for d in left]
            began = time.perf_counter()
            verdicts = [rule.rejects(d) for d in copies]
            seconds = max(time.perf_counter() - began, 1e-9)
            tried.append(((sum(verdicts) + 1e-9) / seconds, -place, rule, seconds, [d for d, gone in zip(copies, verdicts, strict=True) if not gone]))
        _, _, rule, seconds, kept = max(tried, key=lambda x: x[:2])
        order.append((rule.name, seconds, len(left) - len(kept), len(left)))
        todo.remove(rule)
        left = kept
    return order


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample_docs: int = SAMPLE_DOCS, text: str = "text") -> list[Rule]:
    """The rules in the order of :func:`greedy_order` on whole texts of ``sample_docs`` documents.

    The sample meets in one task, which measures; the driver gets the order
    only. Only the order, and with it the time, depends on the sample. Without
    documents the order stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t.as_py() or "" for b in batches for t in b.column(0)]
        names = [name for name, *_ in greedy_order(texts, rules)] if texts else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int64()), pa.array(names, pa.string())], names=["place", "rule"])

    some = docs.select(F.col(text).cast("string").alias("text")).limit(sample_docs).coalesce(1)
    place = {r["rule"]: r["place"] for r in some.mapInArrow(run, "place long, rule string").collect()}
    return sorted(rules, key=lambda rule: place.get(rule.name, len(rules)))


def cascade(d: Text, rules: list[Rule]) -> str | None:
    """The first rule that rejects the document; None if all pass. Later rules are not looked at."""
    return next((r.name for r in rules if r.rejects(d)), None)


def scored(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and verdict of every document, over its whole text, in one pass without a shuffle.

    ``kept`` is false if ``base_failed`` or if the cascade rejects. A null text
    has no words and so fails. Repeated rows and null ids give a row each;
    other columns are ignored; an empty table gives no rows.
    """
    rules = order_rules(docs, text=text) if rules is None else rules
    more = [r for r in rules if r.name not in {b.name for b in BASE}]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list] = [[] for _ in names]
            failed, kept = [], []
            for t in b.column(1):
                d = Text(t.as_py() or "")
                for c, n in zip(counts, names, strict=True):
                    c.append(d.get(n))
                failed.append(any(r.rejects(d) for r in BASE))
                kept.append(not failed[-1] and cascade(d, more) is None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=["doc_id", *names, "base_failed", "kept"])

    return rows.mapInArrow(run, SCHEMA)


def filtered(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that every rule passes, with all their columns.

    Here nothing but the verdict is asked for, so a rejected document costs no
    more than the rules up to the one that rejects it. A null text has no words
    and goes; repeated rows and null ids are judged each; columns of any name
    stay as they are; an empty table gives no rows.
    """
    rules = order_rules(docs, text=text) if rules is None else rules
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([cascade(Text(t.as_py() or ""), rules) is None for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
