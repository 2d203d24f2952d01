"""Searches by beginnings, by pieces of names, and by cells, against all rows."""

import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tentpole.functions import geo, text
from tentpole.operators import cells, finding, search


def some_names(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(["mo", "tör", "head", "sa", "bo", " ", "x", "ri"]) for _ in range(rng.randrange(1, 7))) for _ in range(n)})


@pytest.mark.parametrize("part", [finding.PART, 3])
def test_beginnings_against_all_names(spark, part):
    names, rng = some_names(250, 1), random.Random(2)
    asked = [n[: rng.randrange(len(n) + 1)] for n in names[::3]] + ["", "zz", "mo"]
    table = spark.createDataFrame([(n,) for n in names], "name string").withColumn("name_fold", text.fold("name"))
    q = spark.createDataFrame([(a,) for a in sorted(set(asked))], "q string").withColumn("q_fold", finding.typed("q"))
    folds = {r.name: r.name_fold for r in table.collect()}
    wanted = sorted((r.q, n) for r in q.collect() for n in names if r.q_fold and folds[n].startswith(r.q_fold))
    assert sorted((r.q, r.name) for r in finding.beginning_with(q, table, part).collect()) == wanted and wanted


def test_few_candidates_for_ten_thousand_texts(spark):
    """Names like those of places: a text of some letters meets few that it does not begin."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "au", "er", "el")]
    names = sorted({"".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6))) for _ in range(30_000)})
    table = spark.createDataFrame([(n,) for n in names], "name_fold string")
    asked = spark.createDataFrame([(k, (n := rng.choice(names))[: rng.randrange(4, len(n) + 1)]) for k in range(10_000)], "k int, q_fold string")
    met = asked.withColumn("head", finding.head_of("q_fold")).join(finding.under_heads(table, "name_fold"), "head")
    assert met.count() < 50 * 10_000
    assert finding.beginning_with(asked, table).select("k").distinct().count() == 10_000


@pytest.mark.parametrize("part", [finding.PART, 4])
def test_pieces_against_all_names(spark, part):
    names = some_names(200, 4)
    rows = [(n, len(n) % 5) for n in names]
    asked = ["motor", "Motör", "x", "", None, "he", "  rimo ", "sabo", "nothing", "&amp;", "kurz"]
    table = spark.createDataFrame(rows, "name string, n int")
    index = finding.piece_index(table, spark.createDataFrame([("KURZ", names[3]), ("lost", "no name")], "alias string, name string"))
    folds = {r.name: r.f for r in table.select("name", text.fold("name").alias("f")).collect()}
    words = {r.q: r.f for r in spark.createDataFrame([(a,) for a in asked], "q string").select("q", finding.typed("q").alias("f")).collect()}
    wanted = []
    for q, w in words.items():
        hits = [(-n, name) for name, n in rows if q is not None and len(w) >= 2 and (w in folds[name] or w == "kurz" and name == names[3])]
        wanted += [(q, k + 1, name, -n) for k, (n, name) in enumerate(sorted(hits)[:6])]
    got = finding.names_containing(spark.createDataFrame([(a,) for a in asked], "q string"), index, 6, part)
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert {q for q, *_ in wanted} >= {"motor", "Motör", "he", "kurz"}


def test_a_folded_term_finds_marked_names(spark):
    names = spark.createDataFrame([("Motörhead", 3), ("The Motors", 5), ("Other", 9), ("MOTOR", 5)], "name string, n int")
    assert [r.name for r in search.names_with(names, "motor").collect()] == ["MOTOR", "The Motors", "Motörhead"]
    assert search.names_with(names, "m").count() == 0


HOMES = [(48.1, 11.6), (0.0, 179.9), (-10.3, -179.95), (89.5, 20.0), (-89.9, 0.0), (61.0, -0.2)]


def test_circles_touch_all_cells_that_they_need(spark):
    rng = random.Random(5)
    for home in HOMES:
        for km in (0.0, 30.0, 300.0, 2500.0, 12_000.0):
            parts = cells.stretches(home, km)
            for _ in range(300):
                # A point at most so far away: along a random direction.
                d, b = rng.random() * km / geo.RADIUS_KM, rng.random() * 2 * math.pi
                la = math.radians(home[0])
                lat = math.asin(max(-1.0, min(1.0, math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(b))))
                lon = math.radians(home[1]) + math.atan2(math.sin(b) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(lat))
                lat, lon = math.degrees(lat), (math.degrees(lon) + 180) % 360 - 180
                cell = min(max(math.floor(lat + 90), 0), 179) * 360 + min(math.floor(lon + 180), 359)
                assert any(x <= cell <= y for x, y in parts)


def test_a_stored_copy_gives_the_same_rows_from_few_row_groups(spark, tmp_path):
    n = F.col("id")
    places = spark.range(60_000).select("id", F.concat(F.lit("e"), n.cast("string")).alias("name"), F.when(n % 50 != 0, (n * 7919 % 18000) / 100.0 - 90).alias("lat"), F.when(n % 50 != 0, (n * 104729 % 36000) / 100.0 - 180).alias("lon"),
        F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(False).alias("cancelled"), F.lit(None).cast("double").alias("eur"), F.array(F.lit("g")).alias("genres"))
    path = str(tmp_path / "stored")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        cells.stored(places, path, group_bytes=20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stored = spark.read.parquet(path)
    for home, no_place in (((48.1, 11.6), False), ((-17.0, 179.8), True)):
        wish = search.Search(home=home, km_max=300, undated=True, no_place=no_place)
        ours, theirs = (search.hits(df, wish, 5000).select("id", "km").collect() for df in (stored, places))
        assert ours == theirs and len(ours) > 20
    parts = cells.stretches((48.1, 11.6), 301)
    groups = []
    for f in (tmp_path / "stored").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        for k in range(m.num_row_groups):
            columns = [m.row_group(k).column(c) for c in range(m.num_columns)]
            groups += [c.statistics for c in columns if c.path_in_schema == "cell"]
    read = [s for s in groups if s.has_min_max and any(s.min <= b and s.max >= a for a, b in parts)]
    assert len(groups) >= 50 and 10 * len(read) < len(groups)
    plan = search.hits(stored, search.Search(home=(48.1, 11.6), km_max=300))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(cell" in plan
