"""Registered queries of the sources' parsers: pages in each source's format are made from all orders, then parsed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.functions import geo
from tentpole.functions.text import worked_out
from tentpole.plans.queries import query, spread, table
from tentpole.sources import nodes, parsers

#: What pages say, from the columns of orders; the same in SQL.
FACTS = """SELECT o_orderkey AS id, (o_orderdate + INTERVAL 30 YEAR)::DATE AS d, (o_orderdate + INTERVAL 30 YEAR)::DATE + 2 AS e, (o_custkey % 40)::VARCHAR AS town, o_custkey % 4 AS c, (o_orderkey % 50 + 5)::VARCHAR AS price,
    (o_orderkey % 7)::VARCHAR AS a, (o_orderkey % 5)::VARCHAR AS b, (o_orderkey % 8000 + 100)::VARCHAR AS people, o_orderstatus = 'P' AS off, (o_custkey * 7 % 1700) / 10.0 - 85 AS lat, (o_custkey * 13 % 3500) / 10.0 - 175 AS lon FROM orders"""
COUNTRIES = ["Germany", "Austria", "United Kingdom", "Nowhere"]
CODES = "['DE', 'AT', 'GB'][c + 1]"
TEXT = "strftime(d, '%Y')"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), "o_orderkey")
    day = F.add_months(F.to_date("o_orderdate"), 360)
    text = lambda c: c.cast("string")
    return o.select(
        F.col("o_orderkey").alias("id"), day.alias("d"), F.date_add(day, 2).alias("e"), text(F.col("o_custkey") % 40).alias("town"), F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("country"),
        text(F.col("o_orderkey") % 50 + 5).alias("price"), text(F.col("o_orderkey") % 7).alias("a"), text(F.col("o_orderkey") % 5).alias("b"), text(F.col("o_orderkey") % 8000 + 100).alias("people"), (F.col("o_orderstatus") == "P").alias("off"),
        text((F.col("o_custkey") * 7 % 1700) / 10.0 - 85).alias("lat"), text((F.col("o_custkey") * 13 % 3500) / 10.0 - 175).alias("lon"),
    )


def written(template: str) -> Column:
    """A page from a template with {names} of facts; dates in German (d, e; without year dn, en), ISO (di, ei), English (de, ee) and short (ds, es)."""
    parts = {n: F.col(n).cast("string") for n in ("id", "town", "country", "price", "a", "b", "people", "lat", "lon")} | {"year": F.year("d").cast("string"), "off": F.when(F.col("off"), F.lit("EventCancelled")).otherwise("EventScheduled")}
    for n in "de":
        parts |= {n: F.date_format(n, "dd.MM.yyyy"), n + "n": F.date_format(n, "dd.MM."), n + "i": F.date_format(n, "yyyy-MM-dd"), n + "e": F.date_format(n, "MMMM d, yyyy"), n + "s": F.date_format(n, "dd-MMM-yy"), n + "m": F.date_format(n, "d MMM yyyy")}
    # Every second piece is a name.
    return F.concat(*(parts[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(rf"{{({'|'.join(parts)})}}", template))))


def pages(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    return worked_out(rows, {"html": written(template)}).select(F.concat(F.lit("http://s.example/festivals/"), F.col("id").cast("string")).alias("url"), "html", "id")


def names(spark: SparkSession) -> DataFrame:
    return geo.country_names(geo.states(spark))


SHELL = "<html><head><title>{title}</title><style>p {{ }}</style></head><body><!-- Land: Nowhere --><nav><a href=\"/\">Home</a></nav>{body}<script>var Stadt = 'x';</script></body></html>"


def shell(title: str, body: str) -> str:
    return SHELL.replace("{title}", title).replace("{body}", body)


EVENT = """<script type="application/ld+json">{"@graph": [{"@type": "WebPage", "name": "no"}, {"@type": "MusicFestival", "name": "Fest n{id} {year}", "startDate": "{di}T10:00", "endDate": "{ei}", "eventStatus": "https://schema.org/{off}",
 "location": [{"@type": "Place", "name": "Hall {a}", "address": {"addressLocality": "Street 1, 1234 Town {town}, {country}", "addressCountry": "{country}", "postalCode": "1234"}, "geo": {"latitude": {lat}, "longitude": "{lon}"}}],
 "offers": {"price": "{price}.50", "priceCurrency": "CHF", "url": "http://f{id}.example"}, "performer": [{"name": "Act A{a}"}, "Act B{b}", {"name": "tba"}], "keywords": "Rock, Pop", "isAccessibleForFree": true, "url": "http://e{id}.example"}]}</script>"""
EVENT_PAGE = shell("Fest n{id}", EVENT + '<a href="https://facebook.com/x">f</a><a class="y" href="http://own{id}.example">site</a>')


@query("src16_json_ld", f"WITH f AS ({FACTS}) SELECT id, 'Fest n' || id || ' ' || {TEXT} AS name, 'Hall ' || a AS venue, price || '.50' AS price FROM f")
def json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tentpole.sources import pages as p

    found = p.event_blocks(pages(spark, sf_dir, EVENT_PAGE).withColumnRenamed("id", "page_id"))
    return found.select(F.col("page_id").alias("id"), F.get_json_object("event", "$.name").alias("name"), F.get_json_object(p.first_object(F.col("event"), "location"), "$.name").alias("venue"), F.get_json_object(p.first_object(F.col("event"), "offers"), "$.price").alias("price"))


@query("src07_festapp", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, {TEXT} AS title_year, d AS start, e AS end, 'Hall ' || a AS city, {CODES} AS country, '1234' AS postcode, 'ab CHF ' || price || ',50' AS price, 'http://f' || id || '.example' AS website,
    off AS cancelled, 'Act A' || a || '|Act B' || b AS lineup FROM f WHERE c < 3""")
def festapp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.festapp(pages(spark, sf_dir, EVENT_PAGE), names(spark))
    return out.select("name", "title_year", "start", "end", "city", "country", "postcode", "price", "website", "cancelled", F.array_join("lineup", "|").alias("lineup"))


@query("src12_jambase", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id || ' ' || {TEXT} AS name, d AS start, e AS end, 'Street 1, 1234 Town ' || town || ', ' || ['Germany', 'Austria', 'United Kingdom', 'Nowhere'][c + 1] AS city, round(lat::DOUBLE, 2) AS lat, round(lon::DOUBLE, 2) AS lon,
    'http://own' || id || '.example' AS website, 'Eintritt frei' AS price, off AS cancelled, 'Act A' || a || '|Act B' || b AS lineup FROM f""")
def jambase(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.jambase(pages(spark, sf_dir, EVENT_PAGE))
    return out.select("name", "start", "end", "city", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"), "website", "price", "cancelled", F.array_join("lineup", "|").alias("lineup"))


@query("src11_abroad", f"""WITH f AS ({FACTS}) SELECT CASE WHEN id % 2 = 0 THEN 'Fest n' || id || ' ' || {TEXT} ELSE 'Old Fest n' || id END AS name, CASE WHEN id % 2 = 0 THEN d END AS start, CASE WHEN id % 2 = 0 THEN 'Street 1' ELSE 'Town ' || town END AS city,
    CASE WHEN id % 2 = 0 OR c < 3 THEN ['Germany', 'Austria', 'United Kingdom', 'Nowhere'][c + 1] ELSE '' END AS country, CASE WHEN id % 2 = 0 THEN 'Rock, Pop' ELSE '' END AS genre FROM f""")
def abroad(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = shell("Old Fest n{id} – Town {town}, {country} 2027 | Festival Abroad", "<p>TBA</p>")
    both = pages(spark, sf_dir, EVENT_PAGE).where("id % 2 = 0").unionByName(pages(spark, sf_dir, plain).where("id % 2 = 1"))
    return parsers.abroad(both, names(spark)).select("name", "start", "city", "country", "genre")


@query("src14_festivism", f"""WITH f AS ({FACTS}) SELECT 'World ' || id AS name, 'Town ' || town AS city, ['Germany', 'Austria', 'United Kingdom', 'Nowhere'][c + 1] AS country FROM f WHERE id % 3 = 0""")
def festivism(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = '<script type="application/ld+json">{"@type": "Festival", "name": "World {id}", "eventAttendanceMode": "MODE", "location": {"address": {"addressLocality": "Town {town}, Land", "addressCountry": "COUNTRY"}}}</script>'
    made = lambda country, mode, k: pages(spark, sf_dir, event.replace("COUNTRY", country).replace("MODE", mode)).where(f"id % 3 = {k}")
    return parsers.festivism(made("{country}", "Offline", 0).unionByName(made("xw", "Offline", 1)).unionByName(made("{country}", "OnlineEventAttendanceMode", 2))).select("name", "city", "country")


@query("src09_flyer", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, {TEXT} AS title_year, d AS start, 'Town ' || town AS city, {CODES} AS country, 'Farm ' || a AS venue, off AS cancelled, 'Act A' || a || '|Act B' || b AS lineup FROM f WHERE c < 3""")
def flyer(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = """<script type='application/ld+json'>[{"@type": "Event", "name": "Fest n{id} {year}", "startDate": "{di}", "eventStatus": "{off}", "description": "Lineup: <b>Act A{a}</b> / *Act B{b}* / tba", "location": {"name": "Farm {a}, Cheddar Road, BS40 6LD Town {town}, {country}"}}]</script>"""
    out = parsers.flyer(pages(spark, sf_dir, event), names(spark))
    return out.select("name", "title_year", "start", "city", "country", "venue", "cancelled", F.array_join("lineup", "|").alias("lineup"))


@query("src05_alarm", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, make_date(year(e), month(d), day(d)) AS start, e AS end, 'Town ' || town AS city, '12345' AS postcode, ['Germany', 'Austria', 'United Kingdom', 'Nowhere'][c + 1] AS country, 'Park ' || a AS venue, 'ab ' || price || ' EUR' AS price,
    'http://own' || id || '.example' AS website, 'Rock, Pop' AS genre, people AS visitors, 'Act A' || a || '|Act B' || b AS lineup FROM f""")
def alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """<h1>Fest n{id} {dn} - {e}</h1><ul><li>Festivalticket (ab): <b>ca. {price} €</b></li><li>Tagesticket: -</li><li>Stadt: 12345 Town {town}</li><li>Bundesland: Keine Daten</li><li>Land: {country}</li><li>Veranstaltungsplatz: x</li><li>Örtlichkeit: Park {a}</li>
    <li>Künstler: Act A{a}, Act B{b}, tba</li><li>Anreise: Bahn</li><li>Genres: Rock, Pop</li><li>Gründung: 1999</li><li>Besucher: {people}</li><li>Sonstiges: -</li><li>Webseite: <a href="http://own{id}.example">hier</a></li></ul>"""
    out = parsers.alarm(pages(spark, sf_dir, shell("x", body)))
    return out.select("name", "start", "end", "city", "postcode", "country", "venue", "price", "website", "genre", "visitors", F.array_join("lineup", "|").alias("lineup"))


@query("src06_hopper", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, {TEXT} AS title_year, d AS start, e AS end, 'Town ' || town AS city, '8152' AS postcode, {CODES} AS country, price || ' EUR' AS price, 'http://own' || id || '.example' AS website, 'Rock' AS genre, people AS visitors,
    'Act A' || a || '|Act B' || b AS lineup, '' AS note FROM f WHERE c < 3""")
def hopper(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """<h1>Fest n{id} {year}</h1><p>{d} (Mi) - {e} (Sa)</p><div>Musikart: Rock</div><div>Region: Bayern , 🇩🇪 {country}</div><div>Festivalort: CH-8152 Town {town}</div><div>Besucher: {people}</div><div>Tickets: {price} EUR</div><div>Infos zum Festival</div>
    <a href="/bands/karten/1">Act A{a}</a><a href="/bands/karten/2">Act B{b}</a><a href="/bands/menu">Bands</a><a href="https://facebook.com/x">facebook.com</a><a href="http://own{id}.example">www.own{id}.example</a>"""
    out = parsers.hopper(pages(spark, sf_dir, shell("x", body)), names(spark))
    return out.select("name", "title_year", "start", "end", "city", "postcode", "country", "price", "website", "genre", "visitors", F.array_join("lineup", "|").alias("lineup"), "note")


@query("src08_wannafest", f"""WITH f AS ({FACTS}) SELECT CASE WHEN id % 3 = 0 THEN 'Sommer ' || id ELSE 'Beach Festival ' || id END AS name, d AS start, e AS end, 'Town ' || town AS city, {CODES} AS country, 'Terrein ' || a AS venue, 'http://own' || id || '.example' AS website FROM f WHERE c < 3 AND id % 3 < 2""")
def wannafest(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda name, kind: shell(name + " {id} - WannaFest", '<p>Date {de} to {ee}</p><p>Location Town {town}, {country} Terrein {a}</p><p>Place Type ' + kind + '</p><a href="http://own{id}.example">Official site</a>')
    made = lambda name, kind, k: pages(spark, sf_dir, page(name, kind)).where(f"id % 3 = {k}")
    out = parsers.wannafest(made("Sommer", "Outdoor", 0).unionByName(made("Beach Festival", "Indoor", 1)).unionByName(made("Club night", "Indoor", 2)), names(spark))
    return out.select("name", "start", "end", "city", "country", "venue", "website")


@query("src10_directory", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, d AS start, e AS end, 'Town ' || town AS city, {CODES} AS country, 'http://own' || id || '.example' AS website FROM f WHERE c < 3""")
def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = shell("Fest n{id} {year} | European Festivals Association", '<h1>Cookies</h1><p>{dm} - {em}</p><p>Town {town}, {country}</p><a href="http://own{id}.example">Visit website</a>')
    return parsers.directory(pages(spark, sf_dir, page), names(spark)).select("name", "start", "end", "city", "country", "website")


@query("src13_networks", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, d AS start, 'Town ' || town AS city, round(lat::DOUBLE, 2) AS lat, 'Rock, Pop' AS genre, 'ca. ' || price || ' €' AS price, people AS visitors FROM f WHERE year(d) >= 2027""")
def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    one = written('{"Festival Name": "Fest n{id}", "Start Date": "{ds}", "End Date": "{es}", "City/Region": "Town {town}, Land", "Country": "{country}", "Latitude": {lat}, "Longitude": "{lon}", "Genre": "Rock", "Sub-Genre": "rock, Pop", "Capacity": {people}, "Ticket Price (EUR)": {price}}')
    feeds = f.withColumn("one", one).groupBy((F.col("id") % 100).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("json"))
    broken = spark.createDataFrame([("no json",), (None,)], "json string")
    out = parsers.networks(feeds.select("json").unionByName(broken), 2027)
    return out.select("name", "start", "city", F.round("lat", 2).alias("lat"), "genre", "price", "visitors")


TICKER_PAGE = shell("Page n{id} 2026", """<h2 class="x">12. Fest n{id}</h2><p>Vom: {d} bis: {e}</p><table><tr><td>Stil:</td><td>Rock ... mehr Rock, Pop close</td></tr><tr><td>Ort:</td><td>Town {town}</td></tr><tr><td>Land:</td><td>{country}</td></tr>
 <tr><td>Location:</td><td>Park {a}</td></tr><tr><td>Plz:</td><td>12345</td></tr><tr><td>Preis:</td><td>{price} EUR</td></tr><tr><td>Preis:</td><td>9 EUR</td></tr><tr><td>Website:</td><td><a href="/link/?url=http%3A%2F%2Fown{id}.example">www</a></td></tr>
 <tr><td>Bands:</td><td>Act A{a}, Act B{b}, uvm</td></tr></table>""")
LIST_ROW = """<tbody class="vevent"><tr><td><a class="summary url" href="/festivals/{id}">Listed n{id}</a><span class="dtstart"><span class="value-title" title="{di}"></span></span><span class="dtend"><span class="value-title" title="{ei}"></span></span>
 <span class="location">12345 Listtown {town}</span> Land: de <span title="Jazz">J</span></td></tr></tbody>"""


def list_rows(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """List pages of a thousand orders each, however many there are."""
    rows = facts(spark, sf_dir).where(which).withColumn("seq", F.floor(F.col("id") / 1000)).withColumn("row", written(LIST_ROW))
    return rows.groupBy("seq").agg(F.array_join(F.collect_list("row"), "").alias("html")).withColumn("url", F.lit("http://s.example/list/"))


@query("src03_ticker", f"""WITH f AS ({FACTS}) SELECT CASE WHEN id % 2 = 0 THEN 'Listed n' || id ELSE 'Page n' || id END AS name, d AS start, e AS end, 'Town ' || town AS city, ['Germany', 'Austria', 'United Kingdom', 'Nowhere'][c + 1] AS country, 'Park ' || a AS venue, '12345' AS postcode,
    price || ' EUR' AS price, 'http://own' || id || '.example' AS website, 'Rock Rock, Pop' AS genre, 'Act A' || a || '|Act B' || b AS lineup FROM f""")
def ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.ticker(pages(spark, sf_dir, TICKER_PAGE), parsers.ticker_list(list_rows(spark, sf_dir, "id % 2 = 0"), 1990))
    return out.select("name", "start", "end", "city", "country", "venue", "postcode", "price", "website", "genre", F.array_join("lineup", "|").alias("lineup"))


@query("par08_list_pages", f"WITH f AS ({FACTS}) SELECT 'http://s.example/festivals/' || id AS url, 'Listed n' || id AS name, d AS start, e AS end, 'Listtown ' || town AS city, 'DE' AS country, 'Jazz' AS genre FROM f WHERE year(e) >= 2028")
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.ticker_list(list_rows(spark, sf_dir), 2028)


UNITED_PAGE = shell("x", """<section><h1>Fest n{id} {year}</h1></section><p>01.01.1990 - 02.01.1990</p><p>{d} - {e}</p><p>{d} / 55116 Town {town}</p><p>Fest ist ein Rock Festival</p><p>Tickets ab {price},00 EUR.</p><a href="/festivals/countries/europe">x</a>
 <a href="http://own{id}.example">Offizielle Website</a><div class="card-body"><span class="font-weight-bold" style="white-space: nowrap">Act A{a}</span><span class="text-primary font-weight-normal">Act B{b}</span><br><span class="text-primary font-weight-normal">No act</span> x
 <span class="text-secondary font-weight-bold" style="white-space: nowrap">Nor this</span></div><p>Multi-Genre <b>:</b></p><p>Multi-Genre <span>Rock, Metal UVM</span></p><p>Kapazität: ca. {people}</p>""").replace("var Stadt = 'x';", """{"addressCountry": "{country}", "@type": "Place", "name": "Park {a}", "latitude": {lat}, "longitude": {lon}, "eventStatus": "{off}"}""")


@query("src04_united", f"""WITH f AS ({FACTS}) SELECT 'Fest n' || id AS name, {TEXT} AS title_year, d AS start, e AS end, 'Town ' || town AS city, '55116' AS postcode, coalesce({CODES}, 'Nowhere') AS country, 'Park ' || a AS venue, round(lat::DOUBLE, 2) AS lat, round(lon::DOUBLE, 2) AS lon,
    'ab ' || price || ',00 EUR' AS price, 'http://own' || id || '.example' AS website, 'Rock, Metal' AS genre, people AS visitors, off AS cancelled, 'Act A' || a || '|Act B' || b AS lineup, '' AS note FROM f""")
def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsers.united(pages(spark, sf_dir, UNITED_PAGE), names(spark))
    return out.select("name", "title_year", "start", "end", "city", "postcode", "country", "venue", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"), "price", "website", "genre", "visitors", "cancelled", F.array_join("lineup", "|").alias("lineup"), "note")


@query("src30_addresses", """SELECT 'http://s.example/festivals/fest-' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '-' || year(o_orderdate) ELSE '' END AS url, min(o_custkey) AS place FROM orders WHERE o_orderkey % 2 = 1 OR year(o_orderdate) >= 1998 GROUP BY 1""")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("http://s.example/festivals/fest-"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), F.year("o_orderdate").cast("string"))).otherwise(""))
    loc = lambda c: F.concat(F.lit("<url><loc>"), c, F.lit("</loc></url>"))
    maps = o.groupBy(F.col("o_custkey").alias("place")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(loc(url), loc(F.lit("http://s.example/about")))), ""), F.lit("</urlset>")).alias("xml"))
    # Every address stands on a second map too.
    again = maps.withColumn("place", F.col("place") + 1_000_000)
    return parsers.addresses(maps.unionByName(again), r"http://s\.example/festivals/fest-\d+(?:-(\d{4}))?", 1998)


@query("set03_listed", "SELECT 'http://s.example/f/' || o_orderkey AS url, (o_orderkey % 10 + 1)::INTEGER AS page FROM orders WHERE o_orderkey % 10 < 6")
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("page", (F.col("o_orderkey") % 10 + 1).cast("int"))
    link = F.concat(F.lit('<a href="http://s.example/f/'), F.col("o_orderkey").cast("string"), F.lit('">x</a>'))
    made = o.groupBy("page").agg(F.array_join(F.collect_list(link), "").alias("html"))
    # The seventh page repeats the first; what stands behind it is not asked for any more.
    first = made.where("page = 1").withColumn("page", F.lit(7))
    return parsers.listed(made.where("page <> 7").unionByName(first), r'href="(http://s\.example/f/\d+)"')


@query("srt10_first_addresses", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def first_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.first_of_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)


@query("flt02_isolated", "SELECT CASE WHEN html IS NULL OR length(html) % 3 = 0 THEN 'ValueError: odd page' END AS error, count(*) AS n, coalesce(sum(CASE WHEN html IS NOT NULL AND length(html) % 3 > 0 THEN length(html) END), 0)::BIGINT AS chars FROM pages GROUP BY 1")
def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parse(url: str, html: str) -> dict | None:
        if len(html) % 3 == 0:
            raise ValueError("odd page")
        return {"chars": len(html)}

    rows = parsers.isolated(table(spark, sf_dir, "pages"), parse, "chars long")
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"))


@query("src02_ranks", f"WITH r AS (SELECT unnest({parsers.SOURCES}) AS source, unnest(range(12)) AS rank), f AS (SELECT {parsers.SOURCES}[o_custkey % 12 + 1] AS source, o_orderkey FROM orders) SELECT source, rank::INTEGER AS rank, count(*) AS n, min(o_orderkey) AS first FROM f JOIN r USING (source) GROUP BY 1, 2")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all sources with the trust in their source."""
    source = F.element_at(F.array(*map(F.lit, parsers.SOURCES)), (F.col("o_custkey") % 12 + 1).cast("int"))
    found = table(spark, sf_dir, "orders").select(source.alias("source"), "o_orderkey")
    return found.join(F.broadcast(parsers.source_ranks(spark)), "source").groupBy("source", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("src18_nodes", """WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 4)::INTEGER AS k, (o_custkey % 40)::VARCHAR AS town, o_orderkey % 3 = 0 AS broken FROM orders),
    n AS (
        SELECT id, unnest([0, 1, 2, 3, 4, 5, 6 + 2 * k, 7 + 2 * k, 8 + 2 * k, 9 + 2 * k]) AS pre, unnest([9 + 2 * k, 9 + 2 * k, 9 + 2 * k, 4, 4, 5 + 2 * k, 9 + 2 * k, 7 + 2 * k, 8 + 2 * k, 9 + 2 * k]) AS last, unnest([0, 1, 2, 3, 4, 3, 3, 4, 4, 4]) AS depth,
            unnest([-1, 0, 1, 2, 3, 2, 2, 6 + 2 * k, 6 + 2 * k, 6 + 2 * k]) AS parent, unnest(['html', 'body', 'div', 'h1', '#text', 'ul', 'p', '#text', 'br', '#text']) AS tag, unnest(['', '', '', 'N' || id, 'N' || id, '', 'x t' || town, 'x', '', 't' || town]) AS own FROM o
        UNION ALL SELECT id, 6 + 2 * j, CASE WHEN broken THEN 5 + 2 * k ELSE 7 + 2 * j END, CASE WHEN broken THEN 4 + j ELSE 4 END, CASE WHEN broken AND j > 0 THEN 4 + 2 * j ELSE 5 END, 'li', 'item ' || j FROM o, range(3) AS t(j) WHERE j < k
        UNION ALL SELECT id, 7 + 2 * j, 7 + 2 * j, CASE WHEN broken THEN 5 + j ELSE 5 END, 6 + 2 * j, '#text', 'item ' || j FROM o, range(3) AS t(j) WHERE j < k
    ) SELECT id, pre::INTEGER AS pre, last::INTEGER AS last, depth::INTEGER AS depth, parent::INTEGER AS parent, tag, own FROM n""")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with lists of some items, which are not closed on every third page and so stand one in the other."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 4).cast("int").alias("k"), (F.col("o_custkey") % 40).cast("string").alias("town"))
    items = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.when(j < F.col("k"), F.concat(F.lit("<li>item "), j.cast("string"), F.when(F.col("page_id") % 3 == 0, "").otherwise("</li>"))).otherwise(F.lit("")))
    html = F.concat(F.lit('<html><body><div class="a b"><h1>N'), F.col("page_id").cast("string"), F.lit("</h1><ul>"), F.array_join(items, ""), F.lit("</ul><p>x<br>t"), F.col("town"), F.lit("</p></div></body></html>"))
    return nodes.nodes(o.withColumn("html", html)).select(F.col("page_id").alias("id"), "pre", "last", "depth", "parent", "tag", "own")


PLAIN_HTML = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style|template|textarea|title)\b[^>]*>.*?</(script|style|template|textarea|title)\s*>', '', 'g')"


@query("src18_page_elements", f"SELECT page_id, " + ", ".join(f"len(regexp_extract_all(lower({PLAIN_HTML}), '<{t}[\\s>/]'))::BIGINT AS n_{t}" for t in ("p", "a", "div", "li")) + " FROM pages")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of some kinds each given page has, from its nodes."""
    t = F.col("t")
    count = lambda tag: F.size(nodes.every(t, nodes.tagged(tag))).cast("long").alias(f"n_{tag}")
    return table(spark, sf_dir, "pages").select("page_id", nodes.tree("html").alias("t")).select("page_id", *(count(x) for x in ("p", "a", "div", "li")))


@query("src18_children", """WITH l AS (SELECT l_orderkey AS id, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT id, len(n)::BIGINT AS rows, 'Part ' || n[1] AS first, array_to_string(list_transform(n[2 :], lambda x: 'Part ' || x), '|') AS later FROM l""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of an order's lines: the rows of the table that is named, its first cell, and what stands in the rows after it."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    row = lambda x: F.concat(F.lit("<tr><th>"), x.cast("string"), F.lit("</th><td>Part <b>"), x.cast("string"), F.lit("</b></td></tr>"))
    html = F.concat(F.lit("<table><tr><td>other</td></tr></table><table id=lines>"), F.array_join(F.transform("n", row), "\n"), F.lit("</table><tr><td>after</td></tr>"))
    t, of = F.col("t"), F.col("of")
    rows = lines.select("id", nodes.tree(html).alias("t")).withColumn("of", nodes.first(nodes.every(t, lambda n: (n["tag"] == "table") & (nodes.attribute(n, "id") == "lines")))).withColumn("r", nodes.children(t, of, nodes.tagged("tr")))
    cell = lambda tr: nodes.text_of(t, nodes.first(nodes.children(t, tr, nodes.tagged("td"))))
    first = nodes.first(F.col("r"))
    return rows.select("id", F.size("r").cast("long").alias("rows"), cell(first).alias("first"), F.array_join(F.transform(nodes.following(t, first, nodes.tagged("tr")), cell), "|").alias("later"))
