"""Registered queries of scalar functions over texts as sources write them, dealt over all parts, with what is known of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.functions import dates, geo, lineups, money, text
from tentpole.plans.entity_queries import chosen, entities, textual
from tentpole.plans.queries import query, table
from tentpole.sources import pages as page_source
from tentpole.sources import tables as files


def sql_list(values: list) -> str:
    """Values as a list of DuckDB."""
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "[" + ", ".join(one(v).replace("True", "true").replace("False", "false") for v in values) + "]"


def dealt(n: int, **columns: list) -> str:
    """SQL that deals lists of ``n`` values over all parts."""
    return "SELECT p_partkey, " + ", ".join(f"{sql_list(v)}[p_partkey % {n} + 1] AS {c}" for c, v in columns.items()) + " FROM part"


def said(spark: SparkSession, sf_dir: str, texts: list) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", chosen(F.col("p_partkey") % len(texts), texts).alias("t"))


TEXTS = ["The Straßen &amp; Bären Live", "Motörhead", "Ping + Pong", "12345 Ulm", "ca. 12.000 Leute", "tba", "Preis: 5 €", "19.08.2026", "Tickets hier", "Neu-Ulm 2026", "A feat. B", ""]


@query("txt_texts", dealt(
    12, fold=["strassen and baren", "motorhead", "ping and pong", "12345 ulm", "ca 12 000 leute", "tba", "preis 5", "19 08 2026", "tickets hier", "neu ulm 2026", "a and b", ""],
    tight=["strassenandbaren", "motorhead", "pingandpong", "12345ulm", "ca12000leute", "tba", "preis5", "1908", "ticketshier", "neuulm", "aandb", ""],
    city_key=["strassen and baren", "motorhead", "ping and pong", "ulm", "ca 12 000 leute", "tba", "preis 5", "19 08", "tickets hier", "neu ulm", "a and b", ""],
    joined=["strassenandbaren", "motorhead", "pingandpong", "12345ulm", "ca12000leute", "tba", "preis5", "19082026", "ticketshier", "neuulm2026", "aandb", ""],
    band=[True, True, True, True, True, False, False, False, True, True, True, False],
    visitors=["", "", "", "12345", "12000", "", "", "", "", "2026", "", ""],
    city=["The Straßen & Bären Live", "Motörhead", "Ping + Pong", "Ulm", "ca. 12.000 Leute", "tba", "Preis: 5 €", "19.08.2026", "Tickets hier", "Neu-Ulm 2026", "A feat. B", ""],
    code=["", "", "", "12345", "", "", "", "", "", "", "", ""],
    button=[False, False, False, False, False, False, False, False, True, False, False, False],
    no_year=["The Straßen &amp; Bären Live", "Motörhead", "Ping + Pong", "12345 Ulm", "ca. 12.000 Leute", "tba", "Preis: 5 €", "19.08.", "Tickets hier", "Neu-Ulm", "A feat. B", ""],
    price=["", "", "", "12345 Ulm", "ca. 12.000 Leute", "", "Preis: 5 €", "19.08.2026", "", "Neu-Ulm 2026", "", ""],
    amount=[None, None, None, 12345.0, 12.0, None, 5.0, 1908.2026, None, 2026.0, None, None],
    residue=["The Straßen amp Bären Live", "Motörhead", "Ping Pong", "Ulm", "ca Leute", "tba", "Preis", "", "Tickets hier", "Neu Ulm", "A feat B", ""],
))
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    city, code = text.postcode_and_city("t", F.lit(""))
    return said(spark, sf_dir, TEXTS).select(
        "p_partkey", text.fold("t").alias("fold"), text.tight_key("t").alias("tight"), text.city_key("t").alias("city_key"), text.joined(text.fold("t")).alias("joined"), text.valid_band("t").alias("band"), text.visitors("t").alias("visitors"),
        city.alias("city"), code.alias("code"), text.is_button("t").alias("button"), text.without_year("t").alias("no_year"), money.price_text("t").alias("price"), money.amount("t").alias("amount"), text.price_residue("t").alias("residue"),
    )


DATES = ["2026-08-19", " 19.08.2026\t", "19. 8.2026", "August 19, 2026", "19 Aug 2026", "27-Aug-26", "31.02.2026", "2026-8-1T10", "Mai 5, 2027", "soon", ""]
DAYS = {
    "iso": ["2026-08-19", None, None, None, None, None, None, "2026-08-01", None, None, None], "german": [None, "2026-08-19", "2026-08-19", None, None, None, None, None, None, None, None],
    "english": [None, None, None, "2026-08-19", "2026-08-19", None, None, None, "2027-05-05", None, None], "short": [None, None, None, None, None, "2026-08-27", None, None, None, None, None],
}


@query("dat_formats", dealt(11, **DAYS, age=[12, None, None, None, None, None, None, 30, None, None, None]))
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"iso": dates.from_iso("t"), "german": dates.from_german("t"), "english": dates.from_english("t"), "short": dates.from_short("t")}
    return said(spark, sf_dir, DATES).select("p_partkey", *(textual(c).alias(n) for n, c in made.items()), dates.age_in_days("t", F.lit("2026-08-31").cast("date")).alias("age"))


LINES = ["A1, B2, tba", "17:30 Nebel 19:45 Uhr Sturm", "Nebel (Rock) Sturm (Pop)", "Deep Blue Manfred Mond Earth Band x", "Nebula Allstars", "", "Eins, Zwei Preis: 5"]


@query("txt14_lineups", dealt(7, acts=["A1|B2", "Nebel|Sturm", "Nebel|Sturm", "", "Nebula Allstars", "", "Eins|Zwei"]))
def line_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, LINES).select("p_partkey", F.array_join(lineups.acts("t"), "|").alias("acts"))


LINKS = ["http://a.example/x", "/link/?url=http%3A%2F%2Fb.example&x=1", "http://c.example/?goto=", "https://www.D.example:80/p/festivals/slug/?q=1", "no link", ""]


@query("txt17_links", dealt(6, target=["http://a.example/x", "http://b.example", "http://c.example/?goto=", "https://www.D.example:80/p/festivals/slug/?q=1", "no link", ""], host=["a.example", "", "c.example", "d.example", "", ""], slug=["x", "", "", "slug", "no link", ""]))
def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir, LINKS).select("p_partkey", lineups.link_target("t").alias("target"), text.website_host("t").alias("host"), F.when(F.col("t").contains("link/?"), "").otherwise(text.slug("t")).alias("slug"))


@query("num_places", """SELECT s_suppkey, abs(a) <= 90 AND abs(o) <= 180 AND NOT (a = 0 AND o = 0) AS on_earth, a BETWEEN 8 AND 62 AND o BETWEEN -12 AND 52 AS in_box, (CASE WHEN v >= 1000 THEN ceil(v / 100) * 100 WHEN v >= 200 THEN ceil(v / 50) * 50 ELSE ceil(v / 10) * 10 END)::INTEGER AS rounded,
    ((o - 170 + 180 + 7200) % 360 - 180)::DOUBLE AS turn, round((60 - a) * 3, 3) AS y FROM (SELECT s_suppkey, (s_suppkey * 7 % 200 - 100)::DOUBLE AS a, (s_suppkey * 11 % 400 - 200)::DOUBLE AS o, (s_suppkey * 17 % 3000)::DOUBLE AS v FROM supplier)""")
def place_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select("s_suppkey", (k * 7 % 200 - 100).cast("double").alias("a"), (k * 11 % 400 - 200).cast("double").alias("o"), (k * 17 % 3000).cast("double").alias("v"))
    a, o = F.col("a"), F.col("o")
    box = F.array(*(F.lit(x) for x in (10.0, 60.0, -10.0, 50.0)))
    return df.select("s_suppkey", geo.on_earth(a, o).alias("on_earth"), geo.in_box(a, o, box).alias("in_box"), geo.rounded_up(F.col("v")).alias("rounded"), geo.longitude_difference(F.lit(170.0), o).alias("turn"), F.round(geo.projected(a, o, 60.0, 10.0, 3.0)["y"], 3).alias("y"))


@query("src15_sitemaps", "SELECT page_id, 1::INTEGER AS place, 'http://s.example/' || page_id AS loc FROM pages UNION ALL SELECT page_id, 0, url FROM pages WHERE url IS NOT NULL AND NOT contains(url, '<')")
def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url IS NULL OR NOT contains(url, '<')")
    xml = F.concat(F.lit("<urlset><url><loc>"), F.coalesce("url", F.lit("")), F.lit("</loc></url>\n<url><loc>http://s.example/"), textual(F.col("page_id")), F.lit("</loc></url></urlset>"))
    return p.select("page_id", F.posexplode(page_source.sitemap(xml)).alias("place", "loc"))


@query("snk03_lineups", "SELECT 'Act ' || o_orderkey % 7 AS band, o_orderkey AS id FROM orders UNION ALL SELECT 'act ' || o_custkey % 5, o_orderkey FROM orders")
def lineup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.lineups(entities(spark, sf_dir).select("id", "lineup"))


@query("snk01_export", """SELECT o_orderkey AS id, coalesce(strftime(CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END, '%d.%m.%Y'), '') AS date_from, CASE WHEN 'act ' || o_custkey % 5 < 'act ' || o_orderkey % 7 THEN 'act ' || o_custkey % 5 || '|' || 'Act ' || o_orderkey % 7 WHEN o_custkey % 5 = o_orderkey % 7 THEN 'Act ' || o_orderkey % 7 || '|act ' || o_custkey % 5 ELSE 'Act ' || o_orderkey % 7 || '|' || 'act ' || o_custkey % 5 END AS lineup,
    2::INTEGER AS lineup_count FROM orders""")
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = entities(spark, sf_dir).withColumns({"postcode": F.lit(""), "price_start_seit": F.lit("")})
    out = files.export(shape.withColumn("note", textual(F.col("id"))))
    return out.select(F.col("note").cast("long").alias("id"), "date_from", F.array_join("lineup", "|").alias("lineup"), "lineup_count")
