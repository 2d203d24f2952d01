"""Parsers of the sources' pages: from (url, html) to raw records, as column expressions.

Each takes a table of pages (``url``, ``html``) and gives rows of
:data:`tentpole.plans.schema.RAW`; a page that is no event gives none. Null
pages count as empty. ``names`` is a table from
:func:`tentpole.functions.geo.country_names`. The formats (labels, marks,
addresses) are those of the sources and fixed; what is read with them is told
in each function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.functions import dates, geo, lineups, money, text
from tentpole.functions.text import _text, clean, cleaned, worked_out
from tentpole.sources import nodes
from tentpole.sources import pages as p

#: The sources in order of trust, the most trusted first.
SOURCES = ["ticker", "united", "alarm", "hopper", "festapp", "wannafest", "flyer", "directory", "abroad", "jambase", "networks", "festivism"]
COLUMNS = "url name start end title_year city country venue postcode lat lon price website genre visitors note cancelled lineup".split()
TYPES = {"start": "date", "end": "date", "lat": "double", "lon": "double", "cancelled": "boolean", "lineup": "array<string>"}
NOT_YET = "Termin noch nicht veröffentlicht"
FREE_ENTRY = "Eintritt frei"


def source_ranks(spark: SparkSession) -> DataFrame:
    """``source`` and ``rank``, the place in the order of trust."""
    return spark.createDataFrame(list(zip(SOURCES, range(len(SOURCES)), strict=True)), "source string, rank int")


def records(df: DataFrame, source: str, **columns: Column | str) -> DataFrame:
    """Raw records of a source; what is not given is empty."""
    empty = lambda c: F.lit(False) if c == "cancelled" else F.array().cast("array<string>") if c == "lineup" else F.lit(None).cast(TYPES[c]) if c in TYPES else F.lit("")
    made = {c: (F.col(x) if isinstance(x := columns.get(c, c if c == "url" else empty(c)), str) else x) for c in COLUMNS}
    named = worked_out(df, {"__shown": made["name"]}).where("__shown <> ''")
    made["name"] = F.col("__shown")
    return named.select(F.lit(source).alias("source"), F.lit(SOURCES.index(source)).alias("rank"), *(v.cast(TYPES.get(c, "string")).alias(c) for c, v in made.items()))


def all_findings(every: list[DataFrame]) -> DataFrame:
    """The records of all sources."""
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    return out


def isolated(pages: DataFrame, parse: Callable[[str, str], dict | None], schema: str) -> DataFrame:
    """Rows of a parser in Python, ``parse(url, html)``, for sources whose pages no expression can read.

    A page on which it fails gives a row with the page's ``url`` and the
    ``error`` instead of stopping the job; ``schema`` describes what it gives.
    """
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for url, html in zip(b["url"], b["html"], strict=True):
                try:
                    if (found := parse(url, html or "")) is not None:
                        rows.append({"url": url, "error": None, **found})
                except Exception as e:
                    rows.append({"url": url, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["url", "error", *names]).astype(object).where(lambda x: x.notna(), None)

    return pages.select("url", "html").mapInPandas(run, f"url string, error string, {schema}")


def errors_of(rows: DataFrame, source: str) -> DataFrame:
    """How many pages of a source failed: ``source``, ``n_failed``."""
    return rows.agg(F.count_if(F.col("error").isNotNull()).alias("n_failed")).select(F.lit(source).alias("source"), "n_failed")


# --- addresses


def addresses(sitemaps: DataFrame, pattern: str, since: int | None = None) -> DataFrame:
    """Addresses in sitemaps (``xml``, and ``place`` in their order) that match a pattern as a whole, each once.

    If the pattern's first group is a year, those before ``since`` go before any page is asked for.
    """
    every = sitemaps.select("place", F.explode(p.sitemap("xml")).alias("url"))
    found = every.where(F.col("url").rlike(rf"^(?:{pattern})$"))
    if since is not None:
        year = F.regexp_extract("url", rf"^(?:{pattern})$", 1)
        found = found.where((year == "") | (year.try_cast("int") >= since))
    return found.groupBy("url").agg(F.min("place").alias("place"))


def listed(lists: DataFrame, pattern: str) -> DataFrame:
    """Links of a list that goes over numbered pages (``page`` from 1, ``html``), up to the first page without a new one: ``url``, ``page``."""
    every = lists.select("page", F.explode(F.regexp_extract_all(_text("html"), F.lit(pattern), F.lit(1))).alias("url"))
    first = every.groupBy("url").agg(F.min("page").alias("page"))
    new = lists.select("page").join(first.groupBy("page").agg(F.count(F.lit(1)).alias("n")), "page", "left")
    stop = new.agg(F.min(F.when(F.col("n").isNull(), F.col("page"))).alias("stop"))
    return first.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("page") < F.col("stop"))).select("url", "page")


def first_of_each(df: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each source."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


# --- pages with an event object


def _events(pages: DataFrame, which: str = "named") -> DataFrame:
    """Pages with their event object as ``event``: the first, or the first with a name."""
    some = worked_out(pages, {"__all": F.when(F.contains(F.lower(_text("html")), F.lit("ld+json")), p.event_objects("html"))})
    every = F.col("__all")
    if which == "named":
        every = F.filter(every, lambda e: F.trim(F.coalesce(F.get_json_object(e, "$.name"), F.lit(""))) != "")
    return worked_out(some, {"event": F.try_element_at(every, F.lit(1))}).drop("__all")


#: What is read of an event object and of what it names (fixed values).
FIELDS = {
    "event": "name startDate endDate eventStatus eventAttendanceMode location offers performer keywords description url isAccessibleForFree maximumAttendeeCapacity".split(),
    "place": ["name", "address", "geo"], "offer": ["price", "priceCurrency", "url"], "address": ["addressLocality", "addressCountry", "postalCode"], "geo": ["latitude", "longitude"],
}


def _field(name: str, within: str = "event") -> Column:
    return F.col(f"__{within}_{name}")


def _of(name: str, within: str = "event") -> Column:
    return F.coalesce(_field(name, within), F.lit(""))


def _opened(df: DataFrame, *objects: str) -> DataFrame:
    """The fields of JSON objects as columns; an object is read once for all of them."""
    for x in objects:
        df = df.select("*", F.json_tuple(x, *FIELDS[x]).alias(*(f"__{x}_{f}" for f in FIELDS[x])))
    return df


def _first(name: str, within: str = "event") -> Column:
    """:func:`tentpole.sources.pages.first_object` of a field; only lists are read again."""
    whole = _field(name, within)
    return F.coalesce(F.when(whole.startswith("["), F.get_json_object(F.col(within), f"$.{name}[0]")), whole)


def _parts(df: DataFrame) -> DataFrame:
    """The event's fields, and its place, address, point and offer as JSON texts with theirs; each may be a list, of which the first counts."""
    out = worked_out(_opened(df, "event"), {"place": _first("location"), "offer": _first("offers")})
    out = worked_out(_opened(out, "place", "offer"), {"address": _first("address", "place"), "geo": _first("geo", "place")})
    return _opened(out, "address", "geo")


def _dated() -> dict[str, Column]:
    return {"start": dates.from_iso(_of("startDate")), "end": dates.from_iso(_of("endDate"))}


def _point() -> dict[str, Column]:
    return {"lat": geo.to_number(_of("latitude", "geo")), "lon": geo.to_number(_of("longitude", "geo"))}


def _comma_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def _last(parts: Column, k: int = 1) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))


def _title_year(name: Column) -> Column:
    return F.regexp_extract(name, r"\b(20\d{2})\b", 1)


def _ending(status: str) -> Column:
    return _of("eventStatus").endswith(status)


def price_of(amount: Column, currency: Column) -> Column:
    """``ab EUR 12,50`` of an amount; empty without one."""
    shown = F.replace(F.format_string("%.2f", amount), F.lit("."), F.lit(","))
    return F.when(amount.isNotNull(), F.concat_ws(" ", F.lit("ab"), currency, shown)).otherwise("")


def festapp(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The first event object. The city is the place's name, else the last but one part of the address without postal code; the country is its last part and has to be one."""
    df = worked_out(_parts(_events(pages, "first")), {"name": clean(_of("name")), "parts": _comma_parts(clean(_of("addressLocality", "address"))), "venue": clean(_of("name", "place")), "amount": money.amount(_of("price", "offer"))})
    df = worked_out(df, {"country": F.when(F.size("parts") > 1, _last(F.col("parts"))).otherwise("")})
    df = geo.is_country(geo.country_code(df, "country", names), "country", names).where("is_country")
    street = F.when(F.size("parts") > 1, _last(F.col("parts"), 2)).otherwise(_last(F.col("parts")))
    city = F.when(F.col("venue") != "", F.col("venue")).otherwise(F.regexp_replace(street, r"(?U)^[A-Z]{0,2}[-\s]?\d[\w\s-]*?\s+", ""))
    price = price_of(F.col("amount"), F.coalesce(_field("priceCurrency", "offer"), F.lit("EUR")))
    return records(
        df, "festapp", name=text.without_year("name"), title_year=_title_year(F.col("name")), city=city, country="country", venue="venue", postcode=clean(_of("postalCode", "address")), price=price,
        website=clean(_of("url", "offer")), cancelled=_ending("EventCancelled"), lineup=p.performers(_field("performer")), **_dated(),
    )


def flyer(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The first event object, whose place is one line: venue, street, postal code and town, country. The description lists acts between slashes."""
    df = worked_out(_parts(_events(pages, "first")), {"name": clean(_of("name")), "parts": _comma_parts(clean(_of("name", "place")))})
    df = df.withColumn("country", F.when(F.size("parts") > 1, _last(F.col("parts"))).otherwise(""))
    df = geo.is_country(geo.country_code(df, "country", names), "country", names).where("is_country")
    venue = F.when((F.size("parts") > 2) & (F.length(F.col("parts")[0]) <= 60), F.col("parts")[0]).otherwise("")
    told = F.regexp_replace(_of("description"), r"<[^>]+>", " ")
    acts = F.transform(F.split(told, "/"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(p.plain(x), r"^\*+|\*+$", "")), r"(?i)^(line ?up so far\.?|lineup:?)\s*", ""))
    acts = F.filter(acts, lambda x: text.valid_band(x, cleaned=True) & (F.length(x) <= 60))
    return records(
        df, "flyer", name=text.without_year("name"), title_year=_title_year(F.col("name")), country="country", venue=venue, cancelled=_ending("EventCancelled"), **_dated(),
        city=clean(F.regexp_replace(_last(F.col("parts"), 2), r"^[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d?[A-Z]{0,2}\s+", "")), lineup=F.when(told.contains("/"), acts).otherwise(F.array().cast("array<string>")),
    )


#: Name, place and year in a title, and what follows it on pages without an event object (fixed values).
TITLE = r"(?U)^(.*?)\s+[–-]\s+(.*?)(?:\s+(\d{4}))?$"
TITLE_END = r"\s*[|–-]\s*Festival Abroad\s*$"


def abroad(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The first event object with a name; pages without one have name, city and country in their title, and no date yet."""
    df = worked_out(_parts(_events(pages)), {"name": clean(_of("name"))})
    free = _field("isAccessibleForFree") == "true"
    made = records(
        df.where("event IS NOT NULL"), "abroad", name="name", city=F.element_at(F.split(clean(_of("addressLocality", "address")), ","), 1), country=_of("addressCountry", "address"), venue=clean(_of("name", "place")),
        website=_of("url"), genre=clean(_of("keywords")), visitors=_of("maximumAttendeeCapacity"), price=F.when(free, F.lit(FREE_ENTRY)).otherwise(""), cancelled=F.contains(F.lower(_of("eventStatus")), F.lit("cancel")), **_dated(), **_point(),
    )
    titled = df.where("event IS NULL").withColumn("__title", F.regexp_replace(p.title("html"), TITLE_END, ""))
    where = F.filter(F.transform(F.split(F.regexp_extract("__title", TITLE, 2), ","), lambda x: F.regexp_replace(x, r"^[ .…]+|[ .…]+$", "")), lambda x: x != "")
    titled = titled.where(F.col("__title").rlike(TITLE)).withColumn("__where", where).where("size(__where) >= 2").withColumn("__last", F.element_at("__where", -1))
    titled = geo.is_country(geo.country_code(titled, "__last", names, "__land"), "__land", names)
    return made.unionByName(records(titled, "abroad", name=clean(F.regexp_extract("__title", TITLE, 1)), city=F.col("__where")[0], country=F.when(F.col("is_country"), F.col("__last")).otherwise("")))


#: Hosts of links that are no event's own site (fixed values).
NO_SITE = r"(?i)facebook|twitter|x\.com|instagram|tiktok|youtube|spotify|google\.|jambase|ticketmaster|seetickets|eventbrite|theticketing|axs\.com|bandsintown|linktr\.ee"


def jambase(pages: DataFrame) -> DataFrame:
    """The first event object with a name; the website is the first outbound link that can be the event's own."""
    df = _parts(worked_out(_events(pages).where("event IS NOT NULL"), {"__links": p.anchors("html")}))
    free = _field("isAccessibleForFree") == "true"
    return records(
        df, "jambase", name=clean(_of("name")), city=clean(_of("addressLocality", "address")), country=_of("addressCountry", "address"), venue=clean(_of("name", "place")), postcode=clean(_of("postalCode", "address")),
        website=p.first_link(F.col("__links"), lambda a: a["href"].startswith("http") & ~a["href"].rlike(NO_SITE)), price=F.when(free, F.lit(FREE_ENTRY)).otherwise(""), lineup=p.performers(_field("performer")),
        cancelled=F.contains(F.lower(_of("eventStatus")), F.lit("cancel")), **_dated(), **_point(),
    )


def festivism(pages: DataFrame) -> DataFrame:
    """The first event object with a name, without dates; events in games and online go."""
    df = _parts(_events(pages).where("event IS NOT NULL")).withColumn("country", _of("addressCountry", "address"))
    df = df.where((F.upper("country") != "XW") & ~F.contains(F.lower(_of("eventAttendanceMode")), F.lit("online")))
    return records(df, "festivism", name=clean(_of("name")), city=F.element_at(F.split(clean(_of("addressLocality", "address")), ","), 1), country="country")


FEED = "`Festival Name` string, `Start Date` string, `End Date` string, `City/Region` string, Country string, Latitude string, Longitude string, Website string, Genre string, `Sub-Genre` string, Capacity string, `Ticket Price (EUR)` string"


def networks(feeds: DataFrame, since: int, home: str = "") -> DataFrame:
    """Records of a feed (column ``json``), one JSON array; what is no JSON gives none. Events that began before the year ``since`` go."""
    each = feeds.select(F.explode(F.from_json(F.coalesce("json", F.lit("[]")), f"array<struct<{FEED.replace(' string', ': string')}>>")).alias("e")).select("e.*")
    told = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    df = each.withColumns({"name": clean(told("Festival Name")), "start": dates.from_short(told("Start Date"))}).where(F.col("start").isNull() | (F.year("start") >= since))
    price = F.col("`Ticket Price (EUR)`")
    capacity = told("Capacity")
    return records(
        df.withColumn("url", F.concat(F.lit(f"{home}/#"), "name")), "networks", name="name", start="start", end=dates.from_short(told("End Date")), city=F.element_at(F.split(clean(told("City/Region")), ","), 1), country=told("Country"),
        lat=geo.to_number(told("Latitude")), lon=geo.to_number(told("Longitude")), website=told("Website"), genre=text.genre_union(told("Genre"), told("Sub-Genre")), visitors=F.when(capacity == "0", "").otherwise(capacity),
        price=F.when(F.coalesce(price.try_cast("double"), F.lit(0.0)) != 0, F.concat(F.lit("ca. "), price, F.lit(" €"))).otherwise(""),
    )


# --- pages that are read from their text


#: Labels of pages with labelled fields, each with what ends its value (fixed values).
ALARM = {
    "price": r"Festivalticket \(ab\):\s*(.*?)\s*(?:Tagesticket|Ticketshop|Teilnehmer)", "city": r"Stadt:\s*(.*?)\s*(?:Bundesland:|Land:)", "country": r"\bLand:\s*(.*?)\s*(?:Veranstaltungsplatz|Wo:|Örtlichkeit|Camping)",
    "genre": r"Genres:\s*(.*?)\s*(?:Gründung|Festivalausgabe|Besucher)", "visitors": r"Besucher:\s*(.*?)\s*(?:Sonstiges|Weiterführende|Webseite)", "venue": r"Örtlichkeit:\s*(.*?)\s*(?:Camping|Künstler|Anreise)",
    "acts": r"Künstler:\s*(.*?)\s*(?:Anreise|Wie komme)",
}
HOPPER = {
    "genre": r"Musikart:[^A-Za-z0-9]*(.*?)\s*(?:Region:|Festivalort:|Besucher:)", "region": r"Region:[^A-Za-z0-9]*(.*?)\s*(?:Festivalort:|Besucher:|Tickets:)", "city": r"Festivalort:[^A-Za-z0-9]*(.*?)\s*(?:Besucher:|Tickets:|Infos)",
    "visitors": r"Besucher:\s{0,3}([\d.]{1,9})", "price": r"Tickets:[^A-Za-z0-9]*(.*?)\s*(?:Infos zum|Anfahrt|Lineup)",
}
NOTHING = r"(?i)^(keine daten|unbekannt|keine angabe|-|)$"


def labelled(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Add the value of each label in the flat text of a page, up to the next known label; empty if it says nothing."""
    found = cleaned(df, {k: F.regexp_extract("__flat", f"(?sU){pattern}", 1) for k, pattern in fields.items()})
    return worked_out(found, {k: F.when(F.col(k).rlike(NOTHING), F.lit("")).otherwise(F.col(k)) for k in fields})


def alarm(pages: DataFrame) -> DataFrame:
    """Name and dates from the heading, all else from labelled fields."""
    df = labelled(p.with_flat(cleaned(pages, {"__head": p.raw_element("html", "h1")})), ALARM)
    df = worked_out(cleaned(df, {"price": F.replace(F.replace("price", F.lit("ca."), F.lit("")), F.lit("€"), F.lit("EUR"))}), {"__nodes": nodes.tree("html")})
    span, one = r"^(.*?)(\d{2}\.\d{2}\.)\s*-\s*(\d{2}\.\d{2}\.(\d{4}))", r"^(.*?)(\d{2}\.\d{2}\.\d{4})"
    part = lambda pattern, k: F.regexp_extract("__head", pattern, k)
    spans, dated = F.col("__head").rlike(span), F.col("__head").rlike(one)
    # The match that begins first counts.
    spans = spans & (~dated | (F.length(part(span, 1)) <= F.length(part(one, 1))))
    start = F.when(spans, dates.from_german(F.concat(part(span, 2), part(span, 4)))).when(dated, dates.from_german(part(one, 2)))
    end = F.when(spans, dates.from_german(part(span, 3))).when(dated, dates.from_german(part(one, 2)))
    df = cleaned(df, {"__called": F.when(spans, part(span, 1)).when(dated, part(one, 1)).otherwise(F.col("__head")), "__town": F.regexp_replace("city", r"^\d{4,5}\s*", "")})
    name = F.regexp_replace("__called", r"[\s\-–|]+$", "")
    price = F.col("price")
    price = F.when(~price.rlike(r"\d"), "").when(F.lower(price).startswith("ab"), price).otherwise(F.concat(F.lit("ab "), price))
    # The site is the first link of a list item, box or paragraph that names it, if that link is one.
    tree = F.col("__nodes")
    blocks = nodes.every(tree, lambda n: n["tag"].isin("li", "div", "p") & F.contains(nodes.text_of(tree, n), F.lit("Webseite")))
    hrefs = F.transform(blocks, lambda n: F.trim(nodes.attribute(nodes.first(nodes.below(tree, n, lambda a: (a["tag"] == "a") & nodes.attribute(a, "href").isNotNull())), "href")))
    link = F.coalesce(nodes.first(F.filter(hrefs, lambda h: h.startswith("http") & ~h.contains("awin1.com") & ~h.contains("festival-alarm"))), F.lit(""))
    acts = F.filter(F.transform(F.split("acts", ","), lambda x: text.collapsed(x)), lambda x: text.valid_band(x, cleaned=True))
    return records(
        df, "alarm", name=name, start=start, end=end, city="__town", country="country", venue="venue", postcode=F.regexp_extract("city", r"^\s*(\d{4,5})\b", 1), price=price, website=link,
        genre="genre", visitors="visitors", lineup=acts,
    )


def hopper(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Labelled fields and a span of dates in the text; the region ends with the country, and a page that names no country there goes. Acts are links to their cards."""
    df = labelled(p.with_flat(cleaned(pages, {"__head": p.raw_element("html", "h1")})), HOPPER)
    df = cleaned(worked_out(df, {"__links": p.anchors("html")}), {"country": F.regexp_replace(F.element_at(F.split("region", ","), -1), r"(?U)[^\w ÄÖÜäöüß-]", " ")})
    df = geo.is_country(geo.country_code(df, "country", names), "country", names).where("country = '' OR is_country")
    span = r"(\d{2}\.\d{2}\.\d{4})\s*\(\p{L}{2}\)\s*-\s*(\d{2}\.\d{2}\.\d{4})"
    df = worked_out(df, {f"__day{k}": F.regexp_extract("__flat", span, k) for k in (1, 2)})
    start, end = (dates.from_german(f"__day{k}") for k in (1, 2))
    town = r"^\s*(?:[A-Z]{1,2}-)?(\d{4,5})\b\s*(.*)$"
    acts = F.transform(F.filter("__links", lambda a: a["href"].contains("/bands/karten/")), lambda a: a["text"])
    site = p.first_link(F.col("__links"), lambda a: a["href"].startswith("http") & ~a["href"].contains("festivalhopper") & ~a["href"].rlike("(?i)openstreetmap|facebook|instagram|youtube|twitter|ticket") & F.contains(F.lower(a["href"]), F.replace(F.lower(a["text"]), F.lit("www."), F.lit(""))))
    return records(
        df, "hopper", name=F.trim(F.regexp_replace("__head", r"\s*\b20\d{2}\b\s*$", "")), title_year=_title_year(F.col("__head")), start=start, end=end, country="country",
        city=F.when(F.col("city").rlike(town), clean(F.regexp_extract("city", town, 2))).otherwise(F.col("city")), postcode=F.regexp_extract("city", town, 1), price=F.when(F.col("price").rlike(r"\d"), F.col("price")).otherwise(""),
        website=site, genre="genre", visitors="visitors", note=F.when(start.isNull(), F.lit(NOT_YET)).otherwise(""), lineup=F.filter(acts, lambda x: text.valid_band(x, cleaned=True)),
    )


# Places that are outdoors, and words that name a festival.
OUTDOORS = ["outdoor", "buiten", "draussen", "draußen", "strand", "beach", "boot", "park"]
FESTIVAL_WORD = r"(?iU)festival|open ?air|openair|\bfest\b|weekender|\bdagen\b|\bdays\b|\bfestivals\b"


def wannafest(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Title, dates in English, a city followed by country and venue. Events stay if the place is outdoors or the name says festival."""
    df = pages.withColumns({"name": F.trim(F.regexp_replace(p.title("html"), r"\s*[-–|]\s*WannaFest\s*$", "")), "__flat": p.flat("html"), "__links": p.anchors("html")})
    when = r"(?U)Date\s+(\w+ \d{1,2}, \d{4})[^A-Za-z]*(?:to\s+(\w+ \d{1,2}, \d{4}))?"
    where = r"(?U)Location\s+([^,]{2,40}),\s*(.*?)\s*(?:Place Type|Website|Past events)"
    df = geo.country_first(df.withColumn("__rest", clean(F.regexp_extract("__flat", where, 2))), "__rest", names)
    df = geo.is_country(df, "country_of", names).where("is_country")
    outdoors = F.lower(F.regexp_extract("__flat", r"Place Type\s+([A-Za-zÄÖÜäöü]+)", 1)).isin(OUTDOORS)
    df = df.where(outdoors | F.col("name").rlike(FESTIVAL_WORD))
    venue = F.when((F.length("rest_of") <= 60) & ~text.is_button("rest_of"), F.col("rest_of")).otherwise("")
    return records(
        df, "wannafest", name="name", start=dates.from_english(F.regexp_extract("__flat", when, 1)), end=dates.from_english(F.regexp_extract("__flat", when, 2)), city=clean(F.regexp_extract("__flat", where, 1)), country="country_of", venue=venue,
        website=p.first_link(F.col("__links"), lambda a: F.contains(F.lower(a["text"]), F.lit("official")) & a["href"].startswith("http")),
    )


def directory(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Title, a span of dates, and behind it city and country."""
    title = F.regexp_replace(p.title("html"), r"\s*[-–|]\s*European Festivals Association\s*$", "")
    df = pages.withColumns({"__title": title, "__flat": p.flat("html"), "__links": p.anchors("html")}).where(~F.lower("__title").startswith("we could not find"))
    span = r"(\d{1,2} [A-Z][a-z]{2} \d{4})\s*[-–]\s*(\d{1,2} [A-Z][a-z]{2} \d{4})"
    where = rf"{span}\s*([^,]{{2,40}}),\s*([A-Za-zÄÖÜäöü' \-]{{3,40}}?)\s+(?:Visit|facebook|instagram|X\b|youtube|The |This )"
    df = df.withColumn("country", clean(F.regexp_extract("__flat", where, 4)))
    df = geo.is_country(geo.country_code(df, "country", names), "country", names).where("is_country")
    start, end = (dates.from_english(F.regexp_extract("__flat", span, k)) for k in (1, 2))
    return records(
        df, "directory", name=text.without_year("__title"), start=start, end=end, city=clean(F.regexp_extract("__flat", where, 3)), country="country",
        website=p.first_link(F.col("__links"), lambda a: F.contains(F.lower(a["text"]), F.lit("visit website"))), note=F.when(start.isNull(), F.lit(NOT_YET)).otherwise(""),
    )


# --- a source with list pages


def ticker_list(lists: DataFrame, since: int) -> DataFrame:
    """What list pages (``url``, ``html``, ``seq`` in their order) say of each event: ``url``, ``name``, ``start``, ``end``, ``city``, ``country``, ``genre``.

    Rows carry marks of an event format, with ISO dates in the titles of their
    spans. The end decides whether an event is too old. Of an address that
    stands on several lists the last counts.
    """
    row = r'(?is)<tbody\b[^>]*class="[^"]*\bvevent\b[^"]*"[^>]*>(.*?)</tbody>'
    df = lists.select("url", "seq", F.posexplode(F.regexp_extract_all(_text("html"), F.lit(row), F.lit(1))).alias("pos", "row"))
    link = r'(?is)<a\b(?=[^>]*class="[^"]*\bsummary\b)[^>]*?\bhref="([^"]+)"[^>]*>(.*?)</a>'
    span = lambda kind: rf'(?is)<span\b[^>]*class="[^"]*\b{kind}\b[^"]*"[^>]*>(.*?)</span>'
    day = lambda kind: dates.from_iso(F.regexp_extract("row", rf'(?is)<span\b[^>]*class="[^"]*\b{kind}\b[^"]*"[^>]*>\s*<span\b(?=[^>]*value-title)[^>]*?\btitle="([^"]*)"', 1))
    df = df.where(F.col("row").rlike(link)).withColumns({"start": day("dtstart"), "end": day("dtend"), "place": clean(F.regexp_replace(F.regexp_extract("row", span("location"), 1), "<[^>]*>", " ")), "__flat": p.flat("row")})
    df = df.withColumn("end", F.coalesce("end", "start")).where(F.col("end").isNull() | (F.year("end") >= since))
    bare = F.trim(F.regexp_replace("place", r"(?U)^\d[\w\- ]*?\s+", ""))
    said = df.select(
        p.joined_url(F.col("url"), F.regexp_extract("row", link, 1)).alias("url"), F.struct("seq", "pos").alias("at"),
        F.struct(
            p.plain(F.regexp_extract("row", link, 2)).alias("name"), "start", "end", F.when(bare != "", bare).otherwise(F.col("place")).alias("city"), F.upper(F.regexp_extract("__flat", r"(?U)Land:\s*(\w{2,})", 1)).alias("country"),
            clean(F.regexp_extract("row", r'(?is)<span\b(?![^>]*value-title)[^>]*?\btitle="([^"]*)"', 1)).alias("genre"),
        ).alias("x"),
    )
    return said.groupBy("url").agg(F.max_by("x", "at").alias("x")).select("url", "x.*")


#: Labels of the two-column table (fixed values).
TICKER = ["Stil", "Kategorie", "Preis", "Besucher", "Location", "Plz", "Ort", "Land"]


def ticker(pages: DataFrame, master: DataFrame) -> DataFrame:
    """Detail pages with what their list page said (from :func:`ticker_list`).

    Name and dates of the list win, place, country and style of the page. The
    page has a table of labels and values, of which the first of a label
    counts; line-ups are collected from all.
    """
    lists = master.select("url", *(F.col(c).alias(f"__{c}") for c in ("name", "start", "end", "city", "country", "genre")))
    df = pages.join(lists, "url", "left")
    cells = r"(?is)<tr\b[^>]*>\s*<td\b[^>]*>(.*?)</td>\s*<td\b[^>]*>(.*?)</td>"
    df = worked_out(df, {"__html": F.regexp_replace(_text("html"), "&lt;|&gt;", "")})
    df = p.with_flat(worked_out(df, {"__html": p.decoded("__html")}))
    every = [F.regexp_extract_all("__html", F.lit(cells), F.lit(k)) for k in (1, 2)]
    rows = F.zip_with(*every, lambda a, b: F.struct(F.regexp_replace(p.plain(a), ":+$", "").alias("label"), p.plain(b).alias("value"), b.alias("html")))
    df = worked_out(cleaned(df, {"__title": p.raw_title("html"), "__h2": p.raw_element("html", "h2")}), {"__rows": rows}).drop("__html")
    of = lambda label: F.coalesce(F.try_element_at(F.filter("__rows", lambda r: r["label"] == label), F.lit(1))["value"], F.lit(""))
    value = lambda label: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(of(label), r"\s*\.{2,}\s*mehr\s*", " "), r"\s*close\s*$", "")), r"^[ ,.]+|[ ,.]+$", "")
    filled = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    heading = r"(?is)<h2\b([^>]*)>"
    name = filled(F.coalesce("__name", F.lit("")), F.col("__title"), F.col("__h2"))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"^\d+\.\s*", ""), r"\s+(19|20)\d{2}$", ""))
    cancelled = F.regexp_extract(_text("html"), heading, 1).contains("line-through") | F.col("__flat").rlike("(?i)wurde abgesagt")
    span, one = r"Vom:\s*(\d{2}\.\d{2}\.\d{4})\s*bis:\s*(\d{2}\.\d{2}\.\d{4})", r"\b(\d{2}\.\d{2}\.\d{4})\b"
    day = lambda k: F.when(F.col("__flat").rlike(span), dates.from_german(F.regexp_extract("__flat", span, k))).otherwise(dates.from_german(F.regexp_extract("__flat", one, 1)))
    bands = F.array_join(F.transform(F.filter("__rows", lambda r: r["label"] == "Bands"), lambda r: r["value"]), ", ")
    # The acts of the table, or else of what follows the label in the text.
    df = cleaned(df, {"__bands": bands, "__later": F.regexp_extract("__flat", r"(?s)\bBands:\s*(.+)$", 1)})
    acts, later = (lineups.acts(c, cleaned=True) for c in ("__bands", "__later"))
    site = F.coalesce(F.try_element_at(F.filter("__rows", lambda r: (r["label"] == "Website") & r["html"].contains("href=")), F.lit(1))["html"], F.lit(""))
    href = F.regexp_extract(site, r'(?is)\bhref="([^"]*)"', 1)
    df = worked_out(df, {"__acts": acts, "__site": F.when(href != "", lineups.link_target(p.joined_url(F.col("url"), F.trim(href)))).otherwise("")})
    return records(
        df, "ticker", name=name, start=F.coalesce("__start", day(1)), end=F.coalesce("__end", day(2)), city=filled(value("Ort"), F.col("__city")), country=filled(value("Land"), F.col("__country")), venue=value("Location"),
        postcode=value("Plz"), price=value("Preis"), website="__site", genre=filled(value("Stil"), F.col("__genre"), value("Kategorie")), visitors=value("Besucher"), cancelled=cancelled,
        lineup=F.when(F.size("__acts") > 0, F.col("__acts")).otherwise(later),
    )


# --- a source with text first, embedded JSON for what is missing


#: Currencies in running text (fixed values).
MONEY = "€|EUR|CHF|GBP|DKK|SEK|NOK|PLN|HUF|CZK"


def cards(tree: Column) -> Column:
    """Acts on line-up cards, from a page's nodes: spans in a card's body that are bold and kept on one line, or plain and right before a line end."""
    bodies = nodes.every(tree, lambda n: (n["tag"] == "div") & nodes.has_class(n, "card-body"))
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform(bodies, lambda b: nodes.below(tree, b, nodes.tagged("span"))))))
    leads = lambda n: nodes.has_class(n, "font-weight-bold") & F.contains(F.replace(F.coalesce(nodes.attribute(n, "style"), F.lit("")), F.lit(" "), F.lit("")), F.lit("white-space:nowrap"))
    plays = lambda n: nodes.has_class(n, "text-primary", "font-weight-normal") & F.coalesce(nodes.next_node(tree, n)["tag"] == "br", F.lit(False))
    acts = F.filter(spans, lambda n: ~nodes.has_class(n, "text-secondary") & (leads(n) | plays(n)))
    return F.array_distinct(F.filter(F.transform(acts, lambda n: nodes.text_of(tree, n)), lambda x: text.valid_band(x, cleaned=True)))


def united(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Heading, running text, and embedded JSON where the text is silent.

    The date that counts is that of the edition in the heading. Country: from
    the text, else the embedded address, else the first link to a list of a
    country.
    """
    df = cleaned(pages, {"__head": p.raw_element("html", "h1")}).where("__head <> ''")
    df = worked_out(p.with_flat(df, "__text", between="\n"), {"__nodes": nodes.tree("html"), "__links": p.anchors("html")})
    grab = lambda c, pattern, k=1: F.regexp_extract(c, pattern, k)
    year = _title_year(F.col("__head"))
    spans = [F.regexp_extract_all("__text", F.lit(r"(\d{2}\.\d{2}\.\d{4})(?:\s*-\s*(\d{2}\.\d{2}\.\d{4}))?"), F.lit(k)) for k in (1, 2)]
    df = worked_out(df, {"__year": year, "__spans": F.zip_with(*spans, lambda a, b: F.struct(a.alias("a"), F.when(b != "", b).otherwise(a).alias("b")))})
    y, known = F.col("__year"), F.col("__spans")
    pick = F.when(y == "", F.try_element_at(known, F.lit(1))).otherwise(F.try_element_at(F.filter(known, lambda s: s["a"].endswith(y)), F.lit(1)))
    df = worked_out(worked_out(df, {"__pick": pick}), {"__start": dates.from_german(F.col("__pick.a")), "__end": dates.from_german(F.col("__pick.b"))})
    said = r'"startDate"\s*:\s*"((\d{4})-\d{2}-\d{2})"'
    df = worked_out(df, {"__said": grab("html", said), "__until": grab("html", r'"endDate"\s*:\s*"(\d{4}-\d{2}-\d{2})"')})
    usable = F.col("__start").isNull() & F.col("__said").rlike(".") & ((y == "") | (F.substring("__said", 1, 4) == y))
    json_start = F.when(usable, dates.from_iso("__said"))
    json_end = F.coalesce(dates.from_iso("__until"), json_start)
    note = F.when(usable | F.col("__start").isNotNull() | (y == ""), "").when(F.size(known) == 0, NOT_YET).otherwise(F.concat(F.lit("Termin offen; letzte gefundene Ausgabe "), F.try_element_at(known, F.lit(1))["a"]))
    # Place.
    town = grab("__text", r"\d{2}\.\d{2}\.\d{4}\s*/\s*([^\n]+)")
    held = r"(?U)\bin\s+([A-ZÄÖÜ][^\n,]{1,40}?)\s*\((\w{2})\)"
    filled = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    df = cleaned(df, {"__t0": town, "__t1": grab("__text", held), "__t2": grab("html", r'"addressLocality"\s*:\s*"([^"]{2,60})"'), "__postal": grab("html", r'"postalCode"\s*:\s*"([^"]{2,12})"'), "__c1": grab("html", r'"addressCountry"\s*:\s*"([^"]{2,40})"')})
    city = filled(F.col("__t0"), F.col("__t1"), F.col("__t2"))
    df = worked_out(df, {"__city": F.when(F.trim(city).rlike(r"(?i)^(verschiedene orte|diverse orte|mehrere orte)$"), "").otherwise(city)})
    first = r"^\s*(\d{4,5})\s+([A-Za-zÄÖÜäöü].*)$"
    code = filled(F.replace("__postal", F.lit(" "), F.lit("")), grab("__city", first))
    linked = F.filter(F.regexp_extract_all(_text("html"), F.lit(r'/festivals/countries/([a-z\-]{2,30})"'), F.lit(1)), lambda x: ~x.isin("europe", "international"))
    df = worked_out(df, {"__c0": F.upper(grab("__text", held, 2)), "__c2": F.replace(F.coalesce(F.try_element_at(linked, F.lit(1)), F.lit("")), F.lit("-"), F.lit(" "))})
    df = geo.country_code(geo.country_code(df, "__c1", names), "__c2", names)
    # Price, cancellation, genre, venue, point, website.
    ab = rf"(?i)\bab\s+((?:{MONEY})\s*[\d.,]+|[\d.,]+\s*(?:{MONEY}))"
    told = F.col("__told")
    offer = r'"price"\s*:\s*"([\d.]+)"\s*,\s*"priceCurrency"\s*:\s*"([A-Z]{3})"'
    price = F.when(told != "", F.concat(F.lit("ab "), F.regexp_replace(told, r"[.,;]+$", ""))).otherwise(price_of(money.amount(grab("html", offer)), grab("html", offer, 2)))
    head = grab("html", r"(?is)<(?:section|div)\b[^>]*>((?:(?!<(?:section|div)\b).)*?<h1\b.*?)</(?:section|div)>")
    cancelled = F.contains(F.lower("__text"), F.concat(F.lower("__head"), F.lit(" wurde abgesagt"))) | F.contains(F.lower("__text"), F.concat(F.lower("__head"), F.lit("\nwurde abgesagt"))) | F.col("__header").rlike(r"(?iU)\bAbgesagt\b") | F.col("html").rlike(r'"eventStatus"\s*:\s*"[^"]*EventCancelled"')
    df = cleaned(p.with_flat(df, "__header", head), {
        "__told": grab("__text", ab), "__sentence": F.trim(grab("__text", r"ist ein ([A-Za-zÄÖÜäöü&\- ]{3,40}?) Festival")), "__styles": grab("html", r"(?:Multi-Genre|Genre)\s*<[^>]*>([^<]{3,120})<"),
        "__venue": grab("html", r'"@type"\s*:\s*"Place"\s*,\s*"name"\s*:\s*"([^"]{2,80})"'),
    })
    sentence = F.when(F.col("__sentence").rlike(r"(?i)^angebot\b"), "").otherwise(F.col("__sentence"))
    styles = F.regexp_replace("__styles", r"(?i)\s*\bUVM\.?\s*$", "")
    venue = F.col("__venue")
    point = r'"latitude"\s*:\s*(-?\d+\.?\d*)\s*,\s*"longitude"\s*:\s*(-?\d+\.?\d*)'
    name = F.trim(F.regexp_replace("__head", r"\s*\b20\d{2}\b\s*$", ""))
    site = p.first_link(F.col("__links"), lambda a: ~a["href"].contains("festivalsunited.com") & ~a["href"].startswith("/") & (a["text"].rlike("(?i)offizielle|website|webseite|homepage") | a["title"].rlike("(?i)offizielle|website|homepage")))
    capacity = grab("html", r"Kapazität:\s*(?:ca\.?\s*)?([\d.\s]{3,12})")
    return records(
        df, "united", name=name, start=F.coalesce("__start", json_start), end=F.coalesce("__end", json_end), title_year=filled(y, F.year(F.coalesce("__start", json_start)).cast("string")), note=note,
        city=F.when(F.col("__city").rlike(first), clean(grab("__city", first, 2))).otherwise(F.col("__city")), postcode=code, country=filled(F.col("__c0"), F.col("__c1"), F.col("__c2")), venue=F.when(F.lower(venue) == F.lower(name), "").otherwise(venue),
        lat=grab("html", point).try_cast("double"), lon=grab("html", point, 2).try_cast("double"), price=price, website=site, genre=F.when(styles != "", text.genre_union(styles, sentence)).otherwise(sentence), visitors=F.trim(capacity), cancelled=cancelled, lineup=cards(F.col("__nodes")),
    )
