"""SentencePiece encoding and decoding of merge-type models by a table of prefixes' last tokens.

In a merge-type (BPE) model, a sequence of tokens is an encoding exactly if each
two neighbours are: if the two, written together, are encoded as themselves.
So each prefix of a text has one possible last token: of the tokens that end
there, the one that goes with the last token of what stands before it. An
automaton over all pieces finds the tokens that end at each character, longest
first; the table of last tokens then gives the ids backwards from the end.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a blank in pieces (fixed value).
BLANK = "▁"
#: Pairs of tokens, and stretches of text, that a worker remembers before it starts anew.
PAIRS, STRETCHES = 1_000_000, 600_000
#: Longer stretches are encoded without being remembered.
LONG = 64
#: Tokens, or characters, of the documents that are given on at once.
BATCH = 2_000_000
#: Texts whose ids must equal the library's before a model is used.
PROBES = ("", " ", "a", "  two  blanks\tand\nlines  ", "Straße, naïve ﬁ 東京 ½ 🙂‍▁x", "<s></s><unk><0x0A>", "aaaaaaaaaaaaaaaaaaaaaaa   bbb", "\u0000� x")

codecs.register_error("tentpole.each_byte", lambda e: ("�", e.start + 1))


class Pieces:
    """The pieces of a model file, with the encoder and the decoder.

    For merge-type models with identity normalization, a blank put before the
    text, and bytes for characters without a piece. Any other model is refused:
    its ids on a few probes differ from the library's.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        odd = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in every]
        names = [sp.id_to_piece(i) for i in every]
        self.id = {names[i]: i for i in every if not odd[i]}
        self.score = {names[i]: sp.get_score(i) for i in every if not odd[i]}
        self.byte_id = {int(names[i][1:-1], 16): i for i in every if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError(f"{path} has no pieces for bytes")
        self.bytes = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else names[i].replace(BLANK, " ").encode() for i in every]
        #: Pieces of no text, and pieces that begin with a blank: the first one that is not of no text loses its blank when decoded.
        self.silent = {i for i in every if sp.is_control(i)}
        self.marked = {i for p, i in self.id.items() if p[0] == BLANK}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:  # with each piece: its length, and what may stand before it, as far as that was asked
            self.automaton.add_word(p, (p, len(p), {}))
        self.automaton.make_automaton()
        # No token crosses from another character to a blank if no piece does: such places cut a text into stretches.
        crossing = re.compile(f"[^{BLANK}]{BLANK}")
        self.cut = None if any(crossing.search(p) for p in self.id) else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.pairs = 0
        self.known: dict[str, array] = {}
        for probe in PROBES:
            if list(self.encode(probe)) != sp.encode(probe):
                raise ValueError(f"{path} is not a merge-type model with identity normalization: ids of {probe!r} differ")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: always the neighbours whose join scores best, the first of equals."""
        parts, score = list(text), self.score
        joins = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for k, s in enumerate(joins):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(joins):
                joins[at] = score.get(parts[at] + parts[at + 1])

    def together(self, before: str, token: str, after: dict[str, bool]) -> bool:
        """Whether ``token`` can follow ``before`` (empty at the start): their join is encoded as the two. ``after`` remembers it with the token."""
        if self.pairs >= PAIRS:
            self.pairs = 0
            for _, _, known in self.automaton.values():
                known.clear()
        self.pairs += 1
        ok = after[before] = self.merged(before + token) == ([before, token] if before else [token])
        return ok

    def table(self, stretch: str) -> list[str]:
        """The last token of each prefix of a stretch, the shortest first. A character without a piece is a token of its own."""
        last: list[str] = [""] * (len(stretch) + 1)
        for end, (token, size, after) in self.automaton.iter(stretch):
            end += 1
            if not last[end]:
                before = last[end - size]
                if not before and end > size:  # characters without a piece stand before it
                    self._alone(stretch, last, end - size)
                    before = last[end - size]
                ok = after.get(before)
                if self.together(before, token, after) if ok is None else ok:
                    last[end] = token
        if not last[-1]:
            self._alone(stretch, last, len(stretch))
        return last

    @staticmethod
    def _alone(stretch: str, last: list[str], end: int) -> None:
        while end and not last[end]:
            last[end] = stretch[end - 1]
            end -= 1

    def ids_of(self, stretch: str) -> array:
        """The ids of a stretch, read backwards from the table."""
        last, end, out, of = self.table(stretch), len(stretch), array("i"), self.id
        while end:
            token = last[end]
            if token in of:
                out.append(of[token])
            else:
                out.extend(self.byte_id[b] for b in reversed(token.encode()))
            end -= len(token)
        out.reverse()
        return out

    def encode(self, text: str) -> array:
        """The ids of a text."""
        out = array("i")
        if not text:
            return out
        text, known = BLANK + text.replace(" ", BLANK), self.known
        for s in self.cut.findall(text) if self.cut else [text]:
            ids = known.get(s)
            if ids is None:
                ids = self.ids_of(s)
                if len(s) <= LONG:
                    if len(known) >= STRETCHES:
                        known.clear()
                    known[s] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their mark but the first at the start, bytes joined to characters, a replacement character for each byte that belongs to none."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        if next((i for i in ids if i not in self.silent), None) in self.marked:
            out = out[1:]
        return out.decode("utf-8", "tentpole.each_byte")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The pieces of a model file, loaded once in a worker."""
    return Pieces(path)


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of every whole text: columns ``doc_id`` and ``ids``, in the order and number of the rows.

    A null or empty text has no ids; a null ``doc_id`` stays null; repeated
    rows give repeated rows; other columns are ignored; an empty table gives no
    rows. One pass over the scan, without a shuffle; a worker remembers a
    bounded number of stretches, so memory does not grow with the input.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model)
        held, ends, ids = [], [0], array("i")

        def out() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), lists], names=["doc_id", "ids"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.extend(of.encode(t.as_py() or ""))
                held.append(d)
                ends.append(len(ids))
                if len(ids) >= BATCH:
                    yield out()
                    held, ends, ids = [], [0], array("i")
        if held:
            yield out()

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every row's ids: columns ``doc_id``, ``ids`` and ``text``. Null ids give an empty text; ids outside of the model fail."""
    tokens = tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces(model)
        for b in batches:
            lists, at, size = b.column(1), 0, 0
            texts: list[str] = []
            for k in range(b.num_rows):
                v = lists[k].values
                texts.append(of.decode(v.to_numpy(zero_copy_only=False).tolist()) if v is not None else "")
                size += len(texts[-1])
                if size >= BATCH or k + 1 == b.num_rows:
                    part = b.slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    texts, at, size = [], k + 1, 0

    return tokens.mapInArrow(run, "doc_id long, ids array<int>, text string")
