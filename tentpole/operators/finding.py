"""Names by what users type: an index of beginnings, and one of the pieces inside.

What is typed has no character references, so it is folded without decoding
(``fold(decode=False)``); names are folded as everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tentpole.functions import text
from tentpole.operators.pairing import PART, split_join

#: Lengths of the beginnings that a name stands under; a text asks the longest that it has.
HEADS = (1, 2, 4, 8)
#: Letters of a piece of a name; texts of fewer ask for pieces of two, the least that is looked for.
PIECE, LEAST = 3, 2


def typed(c: Column | str) -> Column:
    """The fold of what a user types."""
    return text.fold(c, decode=False)


def under_heads(names: DataFrame, folded: str) -> DataFrame:
    """Names with ``head``: a row for each beginning of 1, 2, 4 and 8 letters of a folded name, those that it has."""
    heads = F.array(*(F.when(F.length(folded) >= n, F.substring(folded, 1, n)) for n in HEADS))
    return names.withColumn("head", F.explode(F.array_compact(heads)))


def head_of(folded: str) -> Column:
    """The longest of those beginnings that a text has; null for an empty one."""
    return F.coalesce(*(F.when(F.length(folded) >= n, F.substring(folded, 1, n)) for n in HEADS[::-1]))


def beginning_with(asked: DataFrame, names: DataFrame, part: int = PART) -> DataFrame:
    """All rows of ``names`` (with ``name_fold``) whose folded name begins with a text's (``asked`` with ``q_fold``), with the text's columns.

    A text meets only names with its longest indexed beginning, so no more than
    a few letters are left to tell them apart; empty texts find nothing.
    """
    met = split_join(asked.withColumn("head", head_of("q_fold")), under_heads(names, "name_fold"), ["head"], part)
    return met.where(F.col("name_fold").startswith(F.col("q_fold"))).drop("head")


def _pieces(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(c, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def piece_index(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Names (``name``, ``n``: how frequent) under all pieces of two and three letters of their folds: ``piece``, ``name``, ``n``, ``name_fold``.

    With ``aliases`` (``alias``, ``name``) a name stands under those of its
    short forms too.
    """
    rows = names.select("name", "n", text.fold("name").alias("name_fold"))
    if aliases is not None:
        rows = rows.unionByName(aliases.join(names, "name").select("name", "n", text.fold("alias").alias("name_fold")))
    return rows.select(F.explode(F.array_union(_pieces("name_fold", LEAST), _pieces("name_fold", PIECE))).alias("piece"), "name", "n", "name_fold")


def names_containing(asked: DataFrame, index: DataFrame, top: int = 80, part: int = PART) -> DataFrame:
    """For each text (``q``) the ``top`` most frequent names whose fold contains its own: ``q``, ``place`` (from 1), ``name``, ``n``.

    Texts with folds of under two letters find nothing; ties go by name. A text
    looks only at the names under its rarest piece. Of a text with very many
    hits, parts are ranked first, so no task sees more than ``top`` of each.
    """
    q = asked.select("q").where("q IS NOT NULL").distinct().withColumn("q_fold", typed("q")).where(F.length("q_fold") >= LEAST)
    own = F.when(F.length("q_fold") >= PIECE, _pieces("q_fold", PIECE)).otherwise(F.array("q_fold"))
    often = index.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    rarest = q.withColumn("piece", F.explode(own)).join(often, "piece", "left").groupBy("q", "q_fold").agg(F.min_by("piece", F.struct(F.coalesce("often", F.lit(0)), F.col("piece"))).alias("piece"))
    met = split_join(rarest, index.select("piece", "name", "n", "name_fold"), ["piece"], part).where(F.contains(F.col("name_fold"), F.col("q_fold")))
    hits = met.select("q", "name", "n").distinct()
    by = (F.desc("n"), F.col("name"))
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy("q", F.pmod(F.xxhash64("name"), F.lit(64))).orderBy(*by))).where(F.col("place") <= top)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*by))).where(F.col("place") <= top).select("q", "place", "name", "n")
