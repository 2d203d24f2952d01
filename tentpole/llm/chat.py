"""Chat formatting: minimum-cost repair of the turns' roles, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ROLES = (SYSTEM, USER, ASSISTANT)
#: The legal-turn automaton: an optional system turn, then user and assistant in turn, ending with the assistant.
LEGAL = {"": (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ("", ASSISTANT)
#: Costs of the repairs. An empty turn costs most, as it adds what nobody said.
MERGE, RELABEL, INSERT = 1, 2, 3
TEMPLATE = "<|{role}|>\n{text}\n"
SCHEMA = "conv_id long, n_turns long, n_repaired long, cost long, edits string, rendered string"


@dataclass(frozen=True)
class Repair:
    """A legal sequence of (role, texts to join) at the least cost; ``edits`` names the repairs in order."""

    cost: int
    edits: tuple[str, ...]
    turns: tuple[tuple[str, tuple[int, ...]], ...]


def repaired(roles: list[str]) -> Repair:
    """The cheapest way to make the roles legal, by dynamic programming over the automaton.

    A state is the role of the last turn in the repaired sequence. The next
    given turn merges into that turn, if of the same role after a relabel if
    need be, or starts a new one, kept or relabelled, after at most two empty
    turns that the automaton then needs. A role that is none of the three must
    be relabelled. Of equal costs, the repair with fewer edits wins. Of those that
    reach the same state after a turn at equal cost and edits, the one stays that
    treats that turn first in the order keep, merge, relabel, insert.
    """
    # A path is (cost, number of edits, order of the choices), with a link back to build the turns from.
    paths: dict[str, tuple] = {"": (0, 0, (), None, None)}

    def inserted(state: str) -> Iterator[tuple[tuple[str, ...], str]]:
        yield (), state
        for one in LEGAL[state]:
            yield (one,), one
            for two in LEGAL[one]:
                yield (one, two), two

    def better(new: tuple, old: tuple | None) -> bool:
        return old is None or new[:3] < old[:3]

    for k, role in enumerate(roles):
        after: dict[str, tuple] = {}
        for state, path in paths.items():
            for target in ROLES:
                relabel = (target != role) * RELABEL
                if state == target:
                    step = (path[0] + MERGE + relabel, path[1] + 1 + (relabel > 0), (1 + (relabel > 0),), path, ("merge", target, k, (), relabel > 0))
                    if better(step, after.get(target)):
                        after[target] = step
                for empty, before in inserted(state):
                    if target in LEGAL[before]:
                        step = (path[0] + relabel + INSERT * len(empty), path[1] + len(empty) + (relabel > 0), (0 if not empty and not relabel else 2 + len(empty),), path, ("turn", target, k, empty, relabel > 0))
                        if better(step, after.get(target)):
                            after[target] = step
        paths = after
    best = None
    for state, path in paths.items():
        for empty, end in inserted(state):
            if end in FINAL and (end or not roles):
                step = (path[0] + INSERT * len(empty), path[1] + len(empty), (len(empty),), path, ("end", "", -1, empty, False))
                if better(step, best):
                    best = step
    chain, node = [], best
    while node is not None and node[4] is not None:
        chain.append(node[4])
        node = node[3]
    turns: list[tuple[str, list[int]]] = []
    edits: list[str] = []
    for kind, role, k, empty, relabelled in reversed(chain):
        for e in empty:
            turns.append((e, []))
            edits.append(f"insert {e}")
        if relabelled:
            edits.append(f"relabel {k} {role}")
        if kind == "merge":
            edits.append(f"merge {k}")
            turns[-1][1].append(k)
        elif kind == "turn":
            turns.append((role, [k]))
    return Repair(best[0], tuple(edits), tuple((r, tuple(t)) for r, t in turns))


def rendered(repair: Repair, texts: list[str]) -> str:
    """The repaired turns in the template; merged texts are joined by a blank line."""
    return "".join(TEMPLATE.format(role=role, text="\n\n".join(texts[k] for k in own)) for role, own in repair.turns)


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: turns given and after repair, cost, edits, and the rendered text.

    Turns are taken in order of ``turn`` (nulls first), then role and text, so
    ties and repeated rows have one order; roles are trimmed and lower-cased, a
    null role is none of the known; null texts are empty. A turn without a
    ``conv_id`` is a conversation of its own, with a null id, since nothing
    tells which belong together; such turns are dealt by their content, not to
    one task. Other columns are ignored; an empty table gives no rows. A
    conversation's turns meet in one task, where the sort of the shuffle, not
    memory, holds them; only one conversation at a time is in memory.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.lower(F.trim(F.col(role).cast("string"))), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roles, texts, out, size = None, [], [], [], 0

        def close() -> None:
            r = repaired(roles)
            out.append((now, len(roles), len(r.turns), r.cost, "; ".join(r.edits), rendered(r, texts)))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], names=["conv_id", "n_turns", "n_repaired", "cost", "edits", "rendered"])
            out.clear()
            return made

        for b in batches:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != now or c is None:
                    if roles:
                        close()
                        size += len(out[-1][5])
                        if size > 4_000_000:
                            yield batch()
                            size = 0
                    now, roles, texts = c, [], []
                roles.append(r)
                texts.append(t)
        if roles:
            close()
        if out:
            yield batch()

    dealt = rows.withColumn("at", F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).repartition("at").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.drop("at").mapInArrow(run, SCHEMA)
