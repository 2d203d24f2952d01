"""Saved pages as a data source: rows, options that spare pages, and the same rows from a stream that is stopped in between."""

import gzip

import pytest
from pyspark.sql import functions as F

from tentpole.sources import listings


@pytest.fixture
def folder(tmp_path):
    def add(name: str, *urls: str) -> None:
        (tmp_path / "sitemaps").mkdir(exist_ok=True)
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / "sitemaps" / name).write_text("<urlset>" + "".join(f"<url><loc> {u}</loc></url>" for u in urls) + "</urlset>")
        for u in urls:
            file = tmp_path / "pages" / listings.page_name(u)
            if "2019" in u:
                file.with_suffix(".html.gz").write_bytes(b"no archive")  # whoever opens it fails
            elif "missing" not in u:
                file.with_suffix(".html.gz").write_bytes(gzip.compress(f"<h1>{u}</h1>".encode())) if "zip" in u else file.with_suffix(".html").write_text(f"<h1>{u}</h1>")

    add("2026-01.xml", "http://s.example/f/a-2026", "http://s.example/f/b-zip-2025", "http://s.example/f/old-2019")
    add("2026-02.xml", "http://s.example/f/c", "http://s.example/f/missing-2026", "http://s.example/f/a-2026")
    add("empty.txt")
    return tmp_path, add


def rows(df):
    return sorted((r.sitemap, r.place, r.url.rsplit("/", 1)[1], r.year, r.html and len(r.html)) for r in df.collect())


ALL = [("2026-01.xml", 0, "a-2026", 2026, 34), ("2026-01.xml", 1, "b-zip-2025", 2025, 38), ("2026-02.xml", 0, "c", None, 29), ("2026-02.xml", 1, "missing-2026", 2026, None), ("2026-02.xml", 2, "a-2026", 2026, 34)]


def load(spark, path, **options):
    listings.register(spark)
    return spark.read.format("listings").options(**options).load(str(path))


def test_pages_that_are_not_wanted_are_never_opened(spark, folder):
    path, _ = folder
    assert rows(load(spark, path, since=2020)) == ALL
    assert rows(load(spark, path, since=2020, until=2025)) == [ALL[1], ALL[2]]
    assert rows(load(spark, path, since=2026, starts="http://s.example/f/a")) == [ALL[0], ALL[4]]
    with pytest.raises(Exception, match="(?i)gzip"):
        load(spark, path).collect()


def test_filters_of_one_query_leave_the_next_alone(spark, folder):
    path, _ = folder
    df = load(spark, path, since=2020)
    assert [rows(df.where("year > 2025")), rows(df), rows(df.where("sitemap = '2026-02.xml'")), rows(df)] == [[r for r in ALL if r[3] == 2026], ALL, ALL[2:], ALL]


def test_since_keeps_addresses_without_a_year(spark, folder):
    listings.register(spark)
    path, _ = folder
    assert rows(spark.read.format("listings").option("since", 2020).load(path.as_uri())) == ALL
    assert rows(spark.read.format("listings").option("since", 2020).option("year", r"-(\d+)$").load(str(path)).where(F.col("year").isNull())) == [ALL[2]]


def test_a_stream_gives_the_rows_of_the_batch(spark, folder, tmp_path):
    listings.register(spark)
    path, add = folder
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def go() -> None:
        spark.readStream.format("listings").option("since", 2020).load(str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    go()
    assert rows(spark.read.parquet(out)) == ALL
    add("2026-03.xml", "http://s.example/f/new-2027")
    go()
    go()
    assert rows(spark.read.parquet(out)) == rows(spark.read.format("listings").option("since", 2020).load(str(path))) == [*ALL, ("2026-03.xml", 0, "new-2027", 2027, 36)]


def test_no_sitemaps_and_no_path(spark, tmp_path):
    listings.register(spark)
    assert spark.read.format("listings").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("listings").load().collect()
