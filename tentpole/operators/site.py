"""Data that a browser loads: encoded rows with their lists, their contract, labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.functions import geo, money, text
from tentpole.functions.dates import german, iso
from tentpole.functions.text import _text
from tentpole.operators import aggregates

#: The places of a row: what a browser reads by number.
ROW = "name start end city country venue eur price website lat lon lineup note cancelled genres price_start".split()
MOST_PRICE = 5000


def lists(entities: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """The acts (from ``lineup``) and classes (from ``genres``), each numbered from 0 in order of first appearance by ``id``: ``value``, ``id``."""
    number = lambda c: aggregates.dictionary(entities.select(F.col(id).alias("__at"), F.posexplode(c).alias("__pos", "v")).select(F.struct("__at", "__pos").alias("at"), "v"), "v", "at")
    return number("lineup"), number("genres")


def encoded(entities: DataFrame, acts: DataFrame, classes: DataFrame, id: str = "id") -> DataFrame:
    """Entities in the shape of :data:`ROW`, acts and classes as sorted numbers of their lists, dates in ISO, cancelled as 0 or 1."""

    def numbers(column: str, table: DataFrame) -> DataFrame:
        each = entities.select(id, F.explode(column).alias("value")).join(table.select("value", F.col("id").alias("__n")), "value")
        return each.groupBy(id).agg(F.array_sort(F.collect_set("__n")).alias(f"__{column}"))

    none = F.array().cast("array<int>")
    df = entities.join(numbers("lineup", acts), id, "left").join(numbers("genres", classes), id, "left")
    return df.select(
        id, "name", iso("start").alias("start"), iso("end").alias("end"), "city", "country", "venue", "eur", "price", "website", "lat", "lon", F.coalesce("__lineup", none).alias("lineup"), "note",
        F.coalesce(F.col("cancelled"), F.lit(False)).cast("int").alias("cancelled"), F.coalesce("__genres", none).alias("genres"), (F.coalesce("price_start", F.lit("")) if "price_start" in entities.columns else F.lit("")).alias("price_start"),
    )


def decoded(rows: DataFrame, column: str, table: DataFrame, id: str = "id") -> DataFrame:
    """``id`` and the values that a row's numbers stand for, in the row's order."""
    each = rows.select(id, F.posexplode(column).alias("__pos", "__n")).join(table.select(F.col("id").alias("__n"), "value"), "__n")
    return each.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "value"))), lambda x: x["value"]).alias(column))


def contract(acts: DataFrame, classes: DataFrame) -> dict[str, Column]:
    """What no row may break, for the lists it belongs to: their sizes are two numbers."""
    n_acts, n_classes = acts.count(), classes.count()
    within = lambda c, n: F.forall(c, lambda k: (k >= 0) & (k < n))
    return {
        "name is empty": F.trim(_text("name")) == "", "acts out of range": ~within("lineup", n_acts), "classes out of range": ~within("genres", n_classes), "half a point": F.col("lat").isNull() != F.col("lon").isNull(),
        "price out of range": ~F.coalesce(F.col("eur").between(0, MOST_PRICE), F.lit(True)), "dates out of order": (F.col("start") != "") & (F.col("end") != "") & (F.col("end") < F.col("start")), "cancelled is no flag": ~F.col("cancelled").isin(0, 1),
    }


def checked(rows: DataFrame, acts: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows, if none breaks the contract; a job that reads one that does fails with the rule's name."""
    if (columns := [c for c in rows.columns if c in ROW]) != ROW:
        raise ValueError(f"rows have the columns {columns}")
    out = rows
    for name, bad in contract(acts, classes).items():
        out = out.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{name}: "), F.to_json(F.struct("name", "start"))))).otherwise(F.lit(None)).isNull())
    return out


def script_text(df: DataFrame, variable: str = "DATA") -> DataFrame:
    """All rows as one line of script: ``const NAME = JSON.parse('...')``, escaped so that no text ends the string or its element.

    The result is one file that a browser loads as a whole, so it is one row.
    """
    table = df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("t"))
    t = F.col("t")
    for old, new in (("\\", "\\\\"), ("'", "\\'"), ("</", "<\\/"), (" ", "\\u2028"), (" ", "\\u2029")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return table.select(F.concat(F.lit(f"const {variable} = JSON.parse('"), t, F.lit("');")).alias("script"))


def bounds(entities: DataFrame, home: tuple[float, float]) -> DataFrame:
    """One row for the search form: the rectangle of all points, the first month, the farthest distance from ``home`` in km and the highest price, both rounded up."""
    far = F.max(geo.distance_km(*(F.lit(float(x)) for x in home), F.col("lat"), F.col("lon")))
    return entities.agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.trunc(F.min("start"), "MM").alias("first_month"),
        geo.rounded_up(far).alias("farthest"), geo.rounded_up(F.max("eur")).alias("highest_price"),
    )


def audit_table(entities: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Rows of the audit page as HTML: ``id``, ``html``; the sources by their two letters."""
    safe = lambda c: F.replace(F.replace(F.replace(_text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    letters = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    sources = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(F.lit('<a href="'), F.replace(e["value"], F.lit('"'), F.lit("%22")), F.lit('">'), F.coalesce(F.try_element_at(letters, e["key"]), e["key"]), F.lit("</a>"))), " ")
    cells = [safe("name"), F.concat_ws(" – ", F.nullif(german("start"), F.lit("")), F.nullif(german("end"), F.lit(""))), safe("city"), safe("country"), F.size("lineup").cast("string"), sources]
    return entities.select("id", F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>")).alias("html"))


# --- labels


#: Words of labels, to be translated.
WORDS = {"free": "frei", "unknown": "Preis unbekannt", "from": "ab", "first": "Startpreis", "open": "Termin offen"}
FOREIGN = "|".join(sorted(("CHF", "GBP", "USD", "DKK", "SEK", "NOK", "PLN", "CZK", "HUF", "£", r"\$")))


def price_label(words: dict[str, str] = WORDS) -> Column:
    """The price to show, of ``eur``, ``price`` and ``price_start``: free, unknown, in euro with the original of another currency, or the source's text if it says more than its number."""
    raw, first, eur = F.trim(_text("price")), F.trim(_text("price_start")), F.col("eur")
    since = F.when(first != "", F.concat(F.lit(f" ({words['first']} "), first, F.lit(")"))).otherwise("")
    shown = F.concat(F.lit(f"{words['from']} "), F.format_number(eur, 2), F.lit(" €"))
    label = (
        F.when(eur == 0, F.lit(words["free"])).when(eur.isNull(), F.coalesce(F.nullif(raw, F.lit("")), F.lit(words["unknown"])))
        .when(raw.rlike(f"(?i){FOREIGN}"), F.concat(shown, F.lit(" ("), raw, F.lit(")"))).when(text.price_residue("price") != "", raw).otherwise(shown)
    )
    return F.concat(label, since)


def date_label(words: dict[str, str] = WORDS) -> Column:
    """One day, a span, or for undated entities their note."""
    start, end = german("start"), german("end")
    return F.when(F.col("start").isNull(), F.coalesce(F.nullif(_text("note"), F.lit("")), F.lit(words["open"]))).when(F.col("end").isNotNull() & (F.col("end") != F.col("start")), F.concat(start, F.lit(" – "), end)).otherwise(start)


def defaults(country: str | None, first_month: date | None, today: date) -> tuple[str, date]:
    """Currency of a home's country, and the first day to search from: today or, if all events are later, their first month."""
    return money.currency_of(country), max(today, first_month) if first_month else today


def band_rows(names: DataFrame, aliases: DataFrame, asked: str, chosen: dict[str, float] | None = None, top: int = 80) -> DataFrame:
    """Bands that a search for a text shows: ``name``, ``n``, ``aliases``, and the ``weight`` of those already chosen, 0 of the others.

    An alias (``short``, ``full``) leads to its band too. Weights go from 1 to
    2 and back, which is the caller's to keep.
    """
    low = F.lit(asked.lower())
    known = aliases.where(F.lower("short") != F.lower("full"))
    other = known.groupBy(F.col("full").alias("name")).agg(F.array_sort(F.collect_set("short")).alias("aliases"))
    every = names.join(other, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    found = every.where(F.contains(F.lower("name"), low) | F.exists("aliases", lambda a: F.contains(F.lower(a), low)))
    weight = F.lit(0.0)
    for band, w in (chosen or {}).items():
        weight = F.when(F.col("name") == band, F.lit(float(w))).otherwise(weight)
    return found.withColumn("weight", weight).orderBy(F.desc("n"), "name").limit(top)


def alias_index(aliases: DataFrame, acts: DataFrame) -> DataFrame:
    """Aliases (``short``, ``full``) with the number of their act in the list (``value``, ``id``); those that are their own full name go."""
    return aliases.where(F.col("short") != F.col("full")).join(acts.select(F.col("value").alias("full"), F.col("id").alias("band")), "full").select("short", "band")
