"""Numbers of rows in an order, without one task for all."""

import random

from pyspark.sql import functions as F

from tentpole.operators import aggregates, numbering


def test_numbers_follow_the_order_over_all_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(50), k, 7) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, n long, k long, place long").repartition(5)
    got = {r.k: r.at for r in numbering.numbered(df, [F.asc_nulls_last("s"), F.desc("n"), "k"], "at", 1).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1], r[2]))
    assert got == {r[2]: i + 1 for i, r in enumerate(ordered)}


def test_one_value_and_empty_tables(spark):
    same = spark.range(50).select(F.lit("x").alias("v"), "id")
    assert sorted(r.n for r in numbering.numbered(same, ["v"], "n").collect()) == list(range(50))
    assert numbering.numbered(same.where("id < 0"), ["v"], "n").count() == 0


def test_a_dictionary_needs_no_single_partition(spark):
    df = spark.range(300).select((F.col("id") * 7 % 13).cast("string").alias("v"), "id")
    found = aggregates.dictionary(df, "v", "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert [r.value for r in found.orderBy("id").collect()] == [str(k * 7 % 13) for k in range(13)]
