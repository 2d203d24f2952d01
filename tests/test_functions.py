"""Scalar functions, state and resolution on small inputs with known results."""

from datetime import date

from pyspark.sql import functions as F

from tentpole.functions import dates, genres, money, text
from tentpole.operators import lookups, resolve, search, state


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]


def test_fold(spark):
    assert values(spark, ["The Straßen &amp; Bären", "Motörhead Live", None, "Ping + Pong", "Die"], text.fold) == ["strassen and baren", "motorhead", "", "ping and pong", "die"]


def test_event_key(spark):
    assert values(spark, ["Waldrand Open Air 2026", "Seefestival", "Festival", "Fest 2026"], text.event_key) == ["waldrand", "seefestival", "festival", "fest 2026"]


def test_visitors(spark):
    assert values(spark, ["ca. 12.000 Leute", "5", "10 bis 20", None, "99999999999999999999"], text.visitors) == ["12000", "", "", "", ""]


def test_dates_that_do_not_exist_are_null(spark):
    assert values(spark, ["31.02.2026", "1. 8.2026", None], dates.from_german) == [None, date(2026, 8, 1), None]
    assert values(spark, ["27-Aug-26", "27-Xyz-26"], dates.from_short) == [date(2026, 8, 27), None]


def test_prices(spark):
    # A dot separates thousands only in a number with a comma.
    said = ["ab 12,50 €", "Eintritt frei", "20-30 EUR", "", "GBP 10", "1.234,50 €", "1.200 €", None, "frei, sonst 5 €", "5 €, Kinder frei", "ca. 30", "25 bis 40 CHF", "0 €", "9000 EUR", "VVK 20 € AK 25 €", "umsonst und draussen"]
    df = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    got = [r["eur"] for r in money.with_euro(df, "t").orderBy("k").collect()]
    assert got == [12.5, 0.0, 20.0, None, 11.7, 1234.5, 1.2, None, 0.0, 5.0, 30.0, 26.5, None, None, 20.0, 0.0]


def test_genre_rules(spark):
    keywords = {"rock": "rock", "punk": "punk|hardcore", "electronic": "techno", "mixed": "mixed"}
    special = [("hardcore techno", ["electronic"])]
    assert values(spark, ["Rock und Punk", "Hardcore Techno, Mixed", "Mixed", None], lambda c: F.array_join(genres.classes(c, special, keywords, "mixed"), "+")) == ["rock+punk", "electronic", "mixed", ""]


def test_pair_predicates(spark):
    rows = [("neuborn", "noaf neuborn"), ("kiel", "kieler bucht"), ("sonnemondsterne", "sonnemondstern"), ("abc", "abd"), ("", "x")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string").orderBy("k")
    got = df.select(resolve.same_place(F.col("a"), F.col("b")), resolve.covered_name(F.col("a"), F.col("b")), resolve.alike(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False), (False, False, True), (False, False, False), (False, False, False)]


def finding(source, rank, url, name, start, city, **more):
    base = {
        "source": source, "rank": rank, "url": url, "name": name, "start": start, "end": start, "year": str(start.year) if start else "", "city": city, "country": "", "venue": "", "postcode": "", "lat": None, "lon": None,
        "price": "", "website": "", "genre": "", "visitors": "", "note": "", "cancelled": False, "lineup": [],
    }
    return tuple((base | more).values())


def test_merge_fills_and_loses_no_source(spark):
    from tentpole.plans.schema import FINDING

    day = date(2026, 7, 3)
    rows = [
        finding("a", 0, "u1", "Waldrand Festival", day, "Ulm", genre="Rock"), finding("b", 1, "u2", "Waldrand 2026", day, "89073 Ulm", price="10 €", genre="rock, Pop", lat=48.4, lon=10.0),
        finding("c", 2, "u3", "Waldrand", date(2026, 7, 5), "Neu-Ulm", venue="Park"), finding("a", 0, "u4", "Talsee", day, "Bonn"), finding("a", 0, "u5", "Talsee", day, "Köln"),
    ]
    one = resolve.exact(resolve.keyed(spark.createDataFrame(rows, FINDING)))
    assert one.count() == 4
    two = resolve.unique_sources(one).orderBy("name", "city").collect()
    assert [r["sources"] for r in two] == [{"a": "u4"}, {"a": "u5"}, {"a": "u1", "b": "u2", "c": "u3"}]
    w = two[2]
    assert (w["name"], w["price"], w["genre"], w["lat"], w["venue"], w["start"]) == ("Waldrand Festival", "10 €", "Rock, Pop", 48.4, "Park", day)


def test_history_keeps_absent_keys_for_sixty_days(spark):
    none = spark.createDataFrame([], "key string, first string, since date, current string, stamp date")
    run = lambda *rows: spark.createDataFrame([*rows], "key string, price string, seq int")
    h = state.price_history(none, run(("x", "10", 0), ("y", "5", 0), ("z", None, 0), ("x", "11", 1)), date(2026, 1, 1))
    h = state.price_history(h, run(("x", "12", 0)), date(2026, 2, 1))
    assert {r["key"]: (r["first"], r["current"], r["stamp"]) for r in h.collect()} == {"x": ("11", "12", date(2026, 2, 1)), "y": ("5", "5", date(2026, 1, 1))}
    assert [r["key"] for r in state.price_history(h, run(("x", "12", 0)), date(2026, 4, 1)).collect()] == ["x"]


def test_overlapping_pairs_of_a_large_key(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.lit(date(2026, 1, 1)).alias("a"), F.lit(None).cast("date").alias("b"))
    assert [tuple(r) for r in lookups.overlapping_pairs(df, ["k"], "a", "b").collect()] == [(1, 2000 * 1999 // 2)]


def test_search_without_any_wish_returns_all_dated_by_date(spark):
    rows = [(1, "b", None, None), (2, "a", date(2026, 1, 1), 5.0), (3, "c", date(2025, 1, 1), None)]
    df = spark.createDataFrame(rows, "id int, name string, start date, eur double").withColumns({
        "end": F.col("start"), "cancelled": F.lit(None).cast("boolean"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "bands": F.array().cast("array<string>"), "genres": F.lit(None).cast("array<string>"),
    })
    ids = lambda **wish: [r["id"] for r in search.hits(df, search.Search(**wish)).collect()]
    assert ids() == [3, 2] and ids(undated=True) == [3, 2, 1]
    # A step that is on asks for unknown prices and places, with bounds or without.
    assert ids(price_on=True, no_price=False) == [2] and ids(price_on=True) == [3, 2]
    assert ids(home=(50.0, 10.0), distance_on=True) == [] and ids(home=(50.0, 10.0), distance_on=True, no_place=True) == [3, 2]
    assert [r["id"] for r in search.hits(df, search.Search(start=date(2025, 6, 1))).collect()] == [2]


def test_bounds_are_put_in_order():
    s = search.Search(start=date(2026, 8, 1), end=date(2026, 7, 1), km_max=-5, price_min=30, price_max=10, currency="CHF")
    assert search.hints(s, date(2026, 7, 15), date(2026, 9, 1)) == ["price-reversed", "past", "too-early", "eur:31.80", "eur:10.60"]
    c = search.clamped(s, date(2026, 7, 10))
    assert (c.start, c.end, c.km_max, c.price_min) == (date(2026, 7, 1), date(2026, 8, 1), None, 30)


def test_country_names(spark):
    from tentpole.functions import geo

    said = ["Deutschland", "BRD", " Österreich", "oesterreich", "UK", "dänemark", "Daenemark", "Irland", "Ireland", "Holland", "USA", "Vereinigte  Staaten von Amerika", "Suedkorea", "Weissrussland", "Türkei", "Turkey", "Bosnia and Herzegovina", "Kosovo", "jp", "zz", "Bayern", "", None, "Saudi-Arabien", "Czech Republic", "Republik Timbuktu", "Papua-Neuguinea", "Färöer", "FAEROEER"]
    code = ["DE", "DE", "AT", "AT", "GB", "DK", "DK", "IE", "IE", "NL", "US", "US", "KR", "BY", "TR", "TR", "BA", "XK", "JP", "ZZ", "Bayern", "", "", "SA", "CZ", "Republik Timbuktu", "PG", "FO", "FO"]
    known = [c not in ("ZZ", "Bayern", "", "Republik Timbuktu") for c in code]
    names = geo.country_names(geo.states(spark))
    df = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    got = geo.is_country(geo.country_code(df, "t", names, "code"), "code", names).orderBy("k").collect()
    assert [r["code"] for r in got] == code and [r["is_country"] for r in got] == known
    assert len(set(geo.GERMAN_NAMES)) == len(geo.GERMAN_NAMES)
    land = spark.createDataFrame([("United Kingdom Park Hall",), ("Austria Ring",), ("Nowhere At All",), ("",)], "t string")
    assert [(r["country_of"], r["rest_of"]) for r in geo.country_first(land, "t", names).collect()] == [("GB", "Park Hall"), ("AT", "Ring"), ("Nowhere At", ""), ("", "")]
    where = spark.createDataFrame([("DE", "EU"), ("JP", "AS")], "code string, continent string")
    assert [r["continent"] for r in geo.continent(geo.country_code(df, "t", names, "code"), "code", where).orderBy("k").collect()][0] == "EU"
