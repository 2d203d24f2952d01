"""Aggregations of findings, names and places. All combine partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.operators.numbering import numbered


def filled(c: str) -> Column:
    """A text that is not empty, else null; other types as they are."""
    return F.when(F.col(c).cast("string") != "", F.col(c))


def first_filled(df: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Per key and field the first value in ``order`` that is neither null nor empty; null if there is none."""
    by = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(filled(f), F.when(filled(f).isNotNull(), by)).alias(f) for f in fields))


def canonical(df: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """The spelling of each key to show.

    The most frequent one; then one with a capital first letter, in mixed case,
    with fewer dots, the longer one, and last the greatest text.
    """
    v = F.col(variant)
    starts = F.substring(v, 1, 1)
    merits = F.struct(
        F.col("__n"), (starts != F.lower(starts)).alias("upper"), ((v != F.upper(v)) & (v != F.lower(v))).alias("mixed"),
        (-(F.length(v) - F.length(F.replace(v, F.lit("."), F.lit(""))))).alias("dots"), F.length(v).alias("length"), v.alias("text"),
    )
    counted = df.where(v.isNotNull()).groupBy(*keys, variant).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.max_by(variant, merits).alias(variant), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_variants"))


def colliding_aliases(members: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that would join two different acts.

    ``members`` (programme, name) says who is in which programme, ``aliases``
    (short, full) which short names stand for which full ones. An alias is
    disabled if it occurs without its full name somewhere and beside it
    nowhere. Columns short, full, alone, together, disabled; aliases that occur
    nowhere have no row.
    """
    have = members.select("programme", "name").distinct()
    shorts = have.join(aliases, have["name"] == aliases["short"]).select("programme", "short", "full")
    beside = have.select(F.col("programme").alias("__p"), F.col("name").alias("__n"))
    seen = shorts.join(beside, (F.col("programme") == F.col("__p")) & (F.col("full") == F.col("__n")), "left")
    out = seen.groupBy("short", "full").agg(F.count_if(F.col("__n").isNull()).alias("alone"), F.count_if(F.col("__n").isNotNull()).alias("together"))
    return out.withColumn("disabled", (F.col("alone") > 0) & (F.col("together") == 0))


def boxes(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounding box of each key's points, to two decimals."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(key).agg(
        F.round(F.min(lat), 2).alias("lat_min"), F.round(F.max(lat), 2).alias("lat_max"), F.round(F.min(lon), 2).alias("lon_min"), F.round(F.max(lon), 2).alias("lon_max")
    )


def placeholder_points(df: DataFrame, name: str, lat: str = "lat", lon: str = "lon", least: int = 3) -> DataFrame:
    """Points, to four decimals, that ``least`` differently named places share."""
    at = df.select(F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), F.lower(name).alias("__name")).where("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    return at.groupBy("lat", "lon").agg(F.count("__name").alias("n_names")).where(F.col("n_names") >= least)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (a condition that holds for bad rows), in one pass: ``rule``, ``n``; rules that nothing breaks are left out."""
    counts = df.agg(*(F.count_if(bad).alias(f"r{k}") for k, bad in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("n")) for k, name in enumerate(rules)))
    return counts.select(F.explode(pairs).alias("x")).select("x.rule", "x.n").where("n > 0")


def facets(df: DataFrame, values: str, classes: DataFrame | None = None) -> DataFrame:
    """Rows per element of an array column: ``value``, ``n``. With ``classes`` (value), those without rows too."""
    counts = df.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts if classes is None else classes.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values numbered from 0 in order of first appearance: ``value``, ``id``."""
    first = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("__first"))
    return numbered(first, ["__first", "value"], "id").select("value", F.col("id").cast("int").alias("id"))


def by_member(df: DataFrame, member: str, group: str) -> DataFrame:
    """Per member the number of rows and the sorted distinct groups, joined by ``", "``; the members of most rows first."""
    each = df.groupBy(member, group).agg(F.count(F.lit(1)).alias("n"))
    counted = each.groupBy(member).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(group)), ", ").alias("groups"))
    return counted.orderBy(F.desc("n"), F.lower(member), member)


def variants(df: DataFrame, key: str, name: str) -> DataFrame:
    """The spellings of each key: ``key``, ``variants`` (sorted), ``n`` of them."""
    each = df.where(F.col(name).isNotNull()).select(F.col(key).alias("key"), name).distinct()
    return each.groupBy("key").agg(F.array_sort(F.collect_list(name)).alias("variants")).withColumn("n", F.size("variants"))


def variant_report(found: DataFrame, examples: int = 400) -> tuple[DataFrame, DataFrame]:
    """Of keys with their spellings: counts (``raw`` spellings, ``groups``, ``unified`` groups of several), and the first groups of several as examples."""
    counts = found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("raw"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("unified"))
    return counts, found.where("n > 1").orderBy("key").limit(examples)
