"""Helpers shared by the operators: skew-safe lookups and components, besides the intermediate tables of :mod:`tentpole.scratch`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tentpole.scratch import dropped, made, released, saved, scratch_path, shared_dir

__all__ = ["connected_components", "dropped", "heavy_keys", "lookup_join", "made", "released", "saved", "scratch_path", "shared_dir"]

#: A key is heavy when it holds at least this share of the rows, so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.001
#: No key with fewer rows counts as heavy: one task can take that many.
HEAVY_ROWS = 20_000
#: Edges that a task turns into stars before components are sought.
LINKS = 1_000_000


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, least: int = HEAVY_ROWS) -> list:
    """Keys with at least ``max(least, share * rows)`` rows: no more than ``1 / share`` of them."""
    counts = df.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    floor = max(least, int(total * share))
    if total < floor:
        return []
    return [r[0] for r in counts.where(F.col("count") >= floor).collect() if r[0] is not None]


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", heavy: list | None = None) -> DataFrame:
    """Join ``rows`` with ``table`` (at most one row a key) without gathering a heavy key in one task.

    Rows of heavy keys meet a broadcast of at most ``1 / HEAVY_SHARE`` table
    rows where they are; all others are joined by a shuffle, which adaptive
    execution may split further. ``heavy`` saves the count if the caller knows
    the heavy keys.
    """
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    if not heavy:
        return rows.join(table, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    hot = rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), key, how)
    return rows.where(~is_heavy).join(table.where(~is_heavy), key, how).unionByName(hot)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node of some edges but the smallest of its component there: the node and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(np.array([c.to_numpy() for c in b.columns]))
        n += b.num_rows
        if n >= 2 * LINKS:
            held = [np.array(stars(*np.concatenate(held, axis=1)))]
            if (n := held[0].shape[1]) >= LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*np.concatenate(held, axis=1))], names=["u", "v"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Component of every node with an edge: columns ``node`` and ``component`` (its smallest node).

    ``edges`` has the columns ``a`` and ``b`` (long); order, repeats and loops
    do not matter, rows with a null are no edge. Alternates large-star and
    small-star steps, each a minimum by key (combined before the shuffle) and a
    join, until nothing changes; every round is written to the shared folder.
    Before the first, tasks turn about ``LINKS`` edges each into stars, so a
    group that very many edges connect begins with few.
    No component is ever gathered on one task or the driver.
    """
    links = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    some = links.coalesce(max(1, -(-links.count() // LINKS)))
    now, before = saved(some.mapInArrow(_stars, "u long, v long").distinct(), "links"), None
    dropped(links)
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before is not None and tuple(mark) == before:
            break
        before = tuple(mark)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minimum of each node stands by itself before it meets the node's rows again, so that the rows of a node with very many can be split.
        low = saved(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "low")
        large = saved(both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = saved(small.select("e.*").where(F.col("u") != F.col("v")).distinct(), "links")
        for old in (now, low, large, least):
            dropped(old)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
