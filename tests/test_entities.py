"""Parsers' odd pages, places, site data, reports, state and files on small inputs."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tentpole.functions import genres, geo
from tentpole.operators import audit, places, site, state
from tentpole.plans.schema import RAW
from tentpole.sources import parsers, tables
from tentpole.streaming import prices


def pages(spark, *html):
    return spark.createDataFrame([(f"http://s.example/{k}", h) for k, h in enumerate(html)], "url string, html string")


ODD = (None, "", "<html>", "<h1>", "one sentence", "<h1>Name</h1><p>no more", '<script type="application/ld+json">{broken</script>', '<script type="application/ld+json">[]</script>', '<script type="application/ld+json">{"@type": "Event"}</script>')


def test_odd_pages_fail_no_parser(spark):
    known = geo.country_names(geo.states(spark))
    odd = pages(spark, *ODD)
    for parse in (parsers.festapp, parsers.flyer, parsers.abroad, parsers.hopper, parsers.wannafest, parsers.directory, parsers.united):
        out = parse(odd, known)
        assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], RAW).schema]
        assert {r["name"] for r in out.collect()} <= {"Name"}
    for parse in (parsers.alarm, parsers.jambase, parsers.festivism):
        assert {r["name"] for r in parse(odd).collect()} <= {"Name"}
    none = spark.createDataFrame([], "url string, name string, start date, end date, city string, country string, genre string")
    assert parsers.ticker(odd, none).count() == 0
    assert parsers.all_findings([parsers.alarm(odd), parsers.jambase(odd)]).count() == parsers.alarm(odd).count()


def test_united_takes_the_edition_of_its_heading(spark):
    known = geo.country_names(geo.states(spark))
    html = [
        "<h1>Old Fest 2027</h1><p>01.07.2025 - 02.07.2025</p>",
        '<h1>Json Fest 2027</h1><p>01.07.2025</p>{"startDate": "2027-08-01", "endDate": "2027-08-02", "price": "85.5", "priceCurrency": "CHF", "addressCountry": "Switzerland"}',
        "<h1>Off Fest</h1><p>Off Fest wurde abgesagt</p><p>in München (DE), und 01.07.2026 / Verschiedene Orte</p>",
        "<section><h1>Head Fest</h1><b>Abgesagt</b></section><p>Anderes Fest wurde abgesagt</p><p>ist ein Angebot von Live Nation Festival</p>",
    ]
    got = {r["name"]: r for r in parsers.united(pages(spark, *html), known).collect()}
    assert (got["Old Fest"]["start"], got["Old Fest"]["note"]) == (None, "Termin offen; letzte gefundene Ausgabe 01.07.2025")
    j = got["Json Fest"]
    assert (j["start"], j["end"], j["price"], j["country"], j["note"]) == (date(2027, 8, 1), date(2027, 8, 2), "ab CHF 85,50", "CH", "")
    assert (got["Off Fest"]["cancelled"], got["Off Fest"]["city"], got["Off Fest"]["country"]) == (True, "", "DE")
    assert got["Head Fest"]["cancelled"] and got["Head Fest"]["genre"] == ""


def test_ticker_names_dates_and_running_line_ups(spark):
    none = spark.createDataFrame([], "url string, name string, start date, end date, city string, country string, genre string")
    html = [
        "<title>35. Wald Open Air 2026</title><h2 class='line-through'>x</h2><p>am 03.07.2026</p><p>Bands: 17:30 Uhr Nebel 19:45 Uhr Sturm</p>",
        "<h2>Talfest</h2><table><tr><td>Bands:</td><td>Nebel (Rock) Sturm (Pop)</td></tr><tr><td>Ort</td><td>Ulm</td></tr></table>",
    ]
    got = {r["name"]: r for r in parsers.ticker(pages(spark, *html), none).collect()}
    w, t = got["Wald Open Air"], got["Talfest"]
    assert (w["cancelled"], w["start"], w["end"], w["lineup"]) == (True, date(2026, 7, 3), date(2026, 7, 3), ["Nebel", "Sturm"])
    assert (t["city"], t["lineup"], t["start"]) == ("Ulm", ["Nebel", "Sturm"], None)


def test_genre_taxonomy(spark):
    said = {"Melodic Death Metal, Irish Folk": "metal+folk", "hardcore techno": "electronic", "Hardcore (Metal)": "metal+punk", "Multi-Genre": "gemischt", "Multi-Genre, Ska": "reggae", "Elektro/Rap": "hiphop+electronic", "Kinderlieder; Theater": "buehne", "Böhmische Blasmusik": "schlager", "1980er": "gemischt", "xyz": "", None: ""}
    df = spark.createDataFrame([(k,) for k in said], "g string")
    assert {r["g"]: "+".join(r["classes"]) for r in genres.of_event(df, "g").collect()} == said
    assert len(genres.KEYWORDS) == 17


def test_home_by_code_and_by_name(spark):
    codes = spark.createDataFrame([("1010", "Wien", 48.2, 16.4, "AT", 1), ("1010", "Lausanne", 46.5, 6.6, "CH", 2), ("97209", "Veitshöchheim", 49.8, 9.9, "DE", 3)], "code string, place string, lat double, lon double, cc string, seq long")
    known = spark.createDataFrame([("Ulm", 48.4, 10.0, "DE", 120), ("Ulmen", 50.2, 7.0, "DE", 3), ("Ulm", 1.0, 1.0, "US", 5)], "name string, lat double, lon double, cc string, population long")
    asked = spark.createDataFrame([("1010",), ("1010 CH",), ("97209 Veits",), ("1012 AB",), ("ulm",), ("Ulme",), ("nowhere",), ("",)], "q string")
    got = {r["q"]: (r["country"], r["label"], r["others"]) for r in places.home(asked, codes, known).collect()}
    assert got == {"1010": ("AT", "1010 Wien (AT)", 1), "1010 CH": ("CH", "1010 Lausanne (CH)", 0), "97209 Veits": ("DE", "97209 Veitshöchheim (DE)", 0), "ulm": ("DE", "Ulm (DE)", 2), "Ulme": ("DE", "Ulmen (DE)", 0)}


def test_a_row_that_breaks_the_contract_stops_the_job(spark):
    acts = spark.createDataFrame([("A", 0)], "value string, id int")
    classes = spark.createDataFrame([], "value string, id int")
    row = {"name": "X", "start": "2026-01-01", "end": "2026-01-02", "city": "", "country": "", "venue": "", "eur": 5.0, "price": "", "website": "", "lat": 1.0, "lon": 2.0, "lineup": [0], "note": "", "cancelled": 0, "genres": [], "price_start": ""}
    shape = "name string, start string, end string, city string, country string, venue string, eur double, price string, website string, lat double, lon double, lineup array<int>, note string, cancelled int, genres array<int>, price_start string"
    table = lambda **other: spark.createDataFrame([tuple((row | other).values())], shape)
    assert site.checked(table(), acts, classes).count() == 1 and site.checked(table(eur=None, lat=None, lon=None), acts, classes).count() == 1
    for wrong in ({"name": " "}, {"lineup": [1]}, {"lat": None}, {"eur": 5001.0}, {"end": "2025-01-01"}, {"cancelled": 2}, {"genres": [0]}):
        with pytest.raises(Exception, match="name is empty|acts out|half a point|price out|dates out|no flag|classes out"):
            site.checked(table(**wrong), acts, classes).collect()
    with pytest.raises(ValueError):
        site.checked(table().drop("note"), acts, classes)


def test_rules_that_no_good_row_breaks(spark):
    e = spark.createDataFrame([("Fest", "2026", date(2026, 1, 1), None, "Ulm", "DE", "", "10 €", "500", 48.0, 10.0, {"a": "u"}, True), ("Fest", "2026", date(2026, 1, 1), None, "Ulm", "DE", "", "", "", None, None, {"b": "u"}, True), ("Far", "", None, None, "", "", "", "", "", 91.0, 0.0, {"b": "u"}, False)], "name string, year string, start date, end date, city string, country string, venue string, price string, visitors string, lat double, lon double, sources map<string,string>, is_country boolean")
    assert [tuple(r) for r in audit.integrity(e).collect()] == [("duplicate left", 1), ("point not on earth", 1)]


def test_report_of_a_run(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, k int")
    failed = spark.createDataFrame([("http://x.example/1", "404"), ("http://x.example/2", "404"), ("http://y.example", "timeout")], "url string, reason string")
    log = spark.createDataFrame([(k, "x", f"m{k}") for k in range(60)], "seq long, host string, message string")
    warned = spark.createDataFrame([("b", "drop")], "source string, kind string")
    r = audit.report(found, found, "2026-07-01", warned, failed, log, log.where("seq = 50").select("host", "seq")).first()
    assert r["entities"] == 3 and [tuple(x) for x in r["sources"]] == [("a", 2), ("b", 1)] and [x["host"] for x in r["not_loaded_by_host"]] == ["x.example", "y.example"]
    assert len(r["messages"]) == 40 and r["not_loaded_by_reason"][0]["n"] == 2
    assert audit.messages(log, log.where("seq = 5").select("host", "seq")).count() == 6
    codes = audit.short_codes(["ticker", "time", "ti", "united", "t"])
    assert len(set(codes.values())) == 5 and all(len(c) == 2 for c in codes.values()) and codes["ticker"] == "ti"


def test_yields_snapshots_and_totals(spark):
    rows = lambda *x: spark.createDataFrame([*x], "source string, n long")
    carried = spark.createDataFrame([("c", "2026-01-01"), ("d", "soon")], "source string, stamp string")
    before, now = rows(("a", 100), ("b", 100), ("c", 9)), rows(("a", 79), ("b", 80), ("c", 0), ("d", 0), ("e", 0))
    got = {(r["source"], r["kind"]) for r in state.warnings(before, now, carried, date(2026, 2, 1), 200, 150).collect()}
    assert got == {("a", "drop"), ("e", "nothing"), ("c", "old"), ("d", "stamp"), ("total", "drop")}
    assert state.next_total(200, 150, True) == 200 and state.next_total(200, 150, False) == 150
    kept = state.snapshot(spark.createDataFrame([("b", "u2", "n"), ("b", "u1", "n"), ("z", "u", "n")], "source string, url string, name string"), ["b"], "2026-02-01")
    assert [r["url"] for r in kept.collect()] == ["u1", "u2"]


def test_files_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("Fest", ["b", "A"], {"x": "u1", "y": "u2"}), ("Two", [], {})], "name string, lineup array<string>, sources map<string,string>")
    tables.write_csv(e.coalesce(1), tmp_path.as_uri() + "/csv")
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text.startswith("﻿name;lineup;sources".encode()) and b"Fest;b, A;u1 | u2" in text
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    (tmp_path / "bad.json").write_text("{no")
    none = spark.createDataFrame([], "a int")
    read = lambda name: tables.json_or_default(spark, tmp_path.as_uri() + "/" + name, "a int", none).count()
    assert (read("good.json"), read("missing.json"), read("bad.json")) == (1, 0, 0)
    assert (tmp_path / "bad.json.broken").exists() and not (tmp_path / "bad.json").exists()
    feed = lambda name: [r["a"] for r in tables.json_feed(spark, tmp_path.as_uri() + "/" + name, "a: int").collect()]
    assert feed("good.json") == [1] and feed("bad.json.broken") == []
    with io.BytesIO() as b:
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("t.txt", "# comment\tx\ty\n1\tUlm\t48\nshort\n2\t\"Köln\"\t50\n")
        (tmp_path / "t.zip").write_bytes(b.getvalue())
    rows = tables.zipped_lines(spark.read.format("binaryFile").load(tmp_path.as_uri() + "/t.zip"), 3).collect()
    assert [r["cells"] for r in rows] == [["1", "Ulm", "48"], ["2", '"Köln"', "50"]]
    cache = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-09")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("fetched_at"))
    now = F.lit("2026-01-10").cast("timestamp")
    assert [tables.fresh(cache, now, d, b).count() for d, b in ((2, False), (0, False), (30, True))] == [1, 2, 0]


def test_windowed_prices_over_a_stream(spark, tmp_path):
    """A real stream in two batches: late rows within the watermark count, later ones do not."""
    schema = "key string, price double, ts timestamp"
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def add(name, *rows):
        spark.createDataFrame([*rows], "key string, price double, t string").select("key", "price", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*")).rename(source / f"{name}.parquet")

    query = lambda: prices.windowed_prices(spark.readStream.schema(schema).parquet(str(source)), "1 day", "1 day").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    add("one", ("a", 5.0, "2026-01-01 10:00:00"), ("a", 7.0, "2026-01-01 12:00:00"), ("a", None, "2026-01-01 13:00:00"))
    query()
    add("two", ("a", 4.0, "2026-01-01 09:00:00"), ("b", 1.0, "2026-01-05 09:00:00"))
    query()
    add("three", ("a", 99.0, "2026-01-01 11:00:00"), ("b", 2.0, "2026-01-09 09:00:00"))
    query()
    got = {(r["key"], r["first"], r["current"], r["n"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {("a", 4.0, 7.0, 3), ("b", 1.0, 1.0, 1)}
