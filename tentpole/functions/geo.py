"""Coordinates, distances, countries."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tentpole.functions.text import _text, collapsed

RADIUS_KM = 6371.0
#: Degrees by which a country's box is widened: for findings and merged entities, and for a source's own point.
MARGIN, OWN_POINT_MARGIN = 2.0, 1.0
# Countries that sources also name in German; the names come from the Java runtime's locale data.
GERMAN_NAMES = (
    "DE AT CH NL BE FR IT ES PT GB IE DK SE NO FI IS PL CZ SK SI HU HR RS ME BA MK AL XK GR BG RO UA EE LV LT BY LU LI MC AD SM MT CY TR GI FO US CA MX BR AR CO PE CL UY PY EC BO VE CU JM DO "
    "AU NZ JP CN IN ID TH VN PH SG MY KR KP TW KZ UZ GE AM AZ ZA EG MA TN DZ LY KE TZ UG GH NG SN ET IL QA AE SA LB JO IR IQ PK BD NP LK MN KH LA MM CR PA GT HN NI SV BZ FJ PG"
).split()
# What sources call countries beside those names.
OTHER_NAMES = {
    "brd": "DE", "suisse": "CH", "holland": "NL", "england": "GB", "grossbritannien": "GB", "großbritannien": "GB", "schottland": "GB", "wales": "GB", "nordirland": "GB", "uk": "GB", "great britain": "GB",
    "united kingdom": "GB", "tschechische republik": "CZ", "czech republic": "CZ", "bosnien": "BA", "bosnia and herzegovina": "BA", "mazedonien": "MK", "moldawien": "MD", "weissrussland": "BY", "turkey": "TR",
    "vatikan": "VA", "usa": "US", "vereinigte staaten von amerika": "US",
}
#: How letters that a source may lack are written out.
WRITTEN_OUT = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]


@lru_cache(maxsize=2)
def _locale_names(language: str) -> dict[str, str]:
    """Names of all countries in a language, by code, as the Java runtime knows them."""
    locale = SparkSession.getActiveSession()._jvm.java.util.Locale
    shown = locale.forLanguageTag(language)
    codes = [*locale.getISOCountries(), "XK"]
    return {c: locale.forLanguageTag(f"und-{c}").getDisplayCountry(shown) for c in codes}


def states(spark: SparkSession) -> DataFrame:
    """All states (``code``, ``name`` in English) that the Java runtime knows, where no table of them is at hand."""
    return spark.createDataFrame(sorted(_locale_names("en").items()), "code string, name string")


def _spoken_names() -> list[tuple[str, str]]:
    """German names, with and without umlauts, and the others: (name in lower case, code)."""
    out = {}
    for code in GERMAN_NAMES:
        name = plain = _locale_names("de")[code].lower()
        for letter, written in WRITTEN_OUT:
            plain = plain.replace(letter, written)
        out |= {name: code, plain: code}
    return sorted((out | OTHER_NAMES).items())


def distance_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * RADIUS_KM) * F.asin(F.sqrt(h))


def on_earth(lat: Column, lon: Column) -> Column:
    """Whether a point is on the globe and not at 0/0, which stands for no value."""
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 0.01) & (F.abs(lon) < 0.01)), F.lit(False))


def in_box(lat: Column, lon: Column, box: Column, margin: float = MARGIN) -> Column:
    """Whether a point is in a box (array of least and most latitude, least and most longitude); no box holds any point."""
    inside = lat.between(box[0] - margin, box[1] + margin) & lon.between(box[2] - margin, box[3] + margin)
    return F.when(lat.isNull() | lon.isNull(), F.lit(False)).when(box.isNull(), F.lit(True)).otherwise(inside)


def to_number(c: Column | str) -> Column:
    """A coordinate that is a number or its text; null if neither."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def rounded_up(c: Column) -> Column:
    """The next round number: tens, fifties from 200, hundreds from 1000."""
    step = F.when(c >= 1000, 100).when(c >= 200, 50).otherwise(10)
    return (F.ceil(c / step) * step).cast("int")


def longitude_difference(a: Column, b: Column) -> Column:
    """The shorter way from one longitude to another, from -180 to 180."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def projected(lat: Column, lon: Column, centre_lat: float, centre_lon: float, scale: float) -> Column:
    """Equirectangular pixel offsets (x, y) from the centre of a view."""
    x = longitude_difference(F.lit(float(centre_lon)), lon) * F.lit(math.cos(math.radians(centre_lat)) * scale)
    return F.struct(x.alias("x"), ((F.lit(float(centre_lat)) - lat) * scale).alias("y"))


def country_names(countries: DataFrame) -> DataFrame:
    """Lookup table ``name`` to ``code`` from a table of states (``code``, ``name``): codes, names, German names and others, which win."""
    own = countries.select(F.explode(F.array(F.lower("code"), F.lower("name"))).alias("name"), "code").where("name <> ''")
    spoken = countries.sparkSession.createDataFrame(_spoken_names(), "name string, code string")
    return spoken.unionByName(own.join(spoken, "name", "left_anti").groupBy("name").agg(F.min("code").alias("code")))


def _looked_up(names: DataFrame) -> DataFrame:
    """The states of the world, by name or code: a few hundred rows, so the table is broadcast."""
    return F.broadcast(names.select(F.col("name").alias("__name"), F.col("code").alias("__code")))


def country_code(df: DataFrame, column: str, names: DataFrame, out: str | None = None) -> DataFrame:
    """Add the code of a country text: by name, or two letters in upper case, else the text itself."""
    raw = collapsed(_text(column))
    code = F.coalesce(F.col("__code"), F.when(raw.rlike(r"^\p{L}{2}$"), F.upper(raw)), raw)
    return df.join(_looked_up(names), F.lower(raw) == F.col("__name"), "left").withColumn(out or column, code).drop("__name", "__code")


def is_country(df: DataFrame, column: str, names: DataFrame, out: str = "is_country") -> DataFrame:
    """Add whether a code (from :func:`country_code`) is that of a state in ``names``."""
    codes = F.broadcast(names.select(F.col("code").alias("__code")).distinct())
    return df.join(codes, F.col(column) == F.col("__code"), "left").withColumn(out, F.col("__code").isNotNull()).drop("__code")


def continent(df: DataFrame, column: str, countries: DataFrame, out: str = "continent") -> DataFrame:
    """Add the continent of a code from a table of states (``code``, ``continent``); empty if unknown."""
    table = F.broadcast(countries.select(F.col("code").alias("__code"), F.col("continent").alias("__continent")))
    return df.join(table, F.col(column) == F.col("__code"), "left").withColumn(out, F.coalesce("__continent", F.lit(""))).drop("__code", "__continent")


def country_first(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Split a text that begins with a country of three, two or one words: ``country_of``, ``rest_of``; without one the text as a code of its first two words and nothing."""
    words = F.filter(F.split(collapsed(_text(column)), " "), lambda w: w != "")
    start = lambda k: F.array_join(F.slice(words, 1, k), " ")
    out = df
    for k in (3, 2, 1):
        out = is_country(country_code(out.withColumn(f"__s{k}", start(k)), f"__s{k}", names, f"__c{k}"), f"__c{k}", names, f"__is{k}")
    found = [(F.col(f"__is{k}"), k) for k in (3, 2, 1)]
    code, rest = F.when(F.size(words) > 0, F.col("__c2")).otherwise(F.lit("")), F.lit("")
    for is_one, k in found[::-1]:
        code = F.when(is_one, F.col(f"__c{k}")).otherwise(code)
        rest = F.when(is_one, F.array_join(F.slice(words, F.lit(k + 1), F.size(words)), " ")).otherwise(rest)
    return out.withColumns({"country_of": code, "rest_of": rest}).drop(*(f"__{x}{k}" for x in ("s", "c", "is") for k in (1, 2, 3)))


def cleaned_ring(ring: Column) -> Column:
    """An outline (array of [lon, lat]) without the far south, rounded, without points that repeat the one before."""
    kept = F.transform(F.filter(ring, lambda p: p[1] >= -60), lambda p: F.array(F.bround(p[0], 2), F.bround(p[1], 2)))
    return F.aggregate(kept, F.array().cast("array<array<double>>"), lambda got, p: F.when(F.try_element_at(got, F.lit(-1)).eqNullSafe(p), got).otherwise(F.array_append(got, p)))


def ring_box(ring: Column) -> Column:
    """Least and most latitude, least and most longitude of an outline."""
    lat, lon = F.transform(ring, lambda p: p[1]), F.transform(ring, lambda p: p[0])
    return F.array(F.array_min(lat), F.array_max(lat), F.array_min(lon), F.array_max(lon))


def worthwhile_ring(ring: Column, box: Column, extent: float = 0.35) -> Column:
    """Whether a cleaned outline has five points, meets the box, and is large enough to draw."""
    own = ring_box(ring)
    meets = (own[0] <= box[1]) & (own[1] >= box[0]) & (own[2] <= box[3]) & (own[3] >= box[2])
    return (F.size(ring) >= 5) & meets & (F.greatest(own[1] - own[0], own[3] - own[2]) >= extent)
