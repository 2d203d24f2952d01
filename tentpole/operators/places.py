"""Where events are: lookups of places in tiers, gazetteers, a user's home."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tentpole.functions import geo, text
from tentpole.functions.text import _text
from tentpole.operators import finding

# --- tables that lookups use


def populated_places(rows: DataFrame) -> DataFrame:
    """Gazetteer of (name, ascii, lat, lon, cc, population, seq): per name without case and country the most populous, the first on ties.

    A place's spelling in ASCII stands beside its name where it is another.
    """
    key = lambda c: F.lower(F.trim(c))
    at = F.struct((-F.coalesce("population", F.lit(0))).alias("p"), "seq")
    best = rows.where("name IS NOT NULL AND cc IS NOT NULL").groupBy(key("name").alias("key"), "cc").agg(F.min_by(F.struct("name", "ascii", "lat", "lon", "population"), at).alias("x")).select("key", "cc", "x.*")
    ascii_ = best.where(F.coalesce(key("ascii"), F.lit("")).isin("") == F.lit(False)).where(key("ascii") != F.col("key"))
    other = ascii_.groupBy(key("ascii").alias("key"), "cc").agg(F.max_by(F.struct(F.col("ascii").alias("name"), "lat", "lon", "population"), F.struct("population", "name")).alias("x")).select("key", "cc", "x.*")
    other = other.join(best.select("key", "cc"), ["key", "cc"], "left_anti")
    return best.select("key", "name", "lat", "lon", "cc", "population").unionByName(other.select("key", "name", "lat", "lon", "cc", "population"))


def by_population(places: DataFrame) -> DataFrame:
    """The most populous first."""
    return places.orderBy(F.desc("population"), "name", "cc")


def postal_codes(rows: DataFrame) -> DataFrame:
    """The first row of each code and country of (code, place, lat, lon, cc, seq)."""
    first = rows.where("code IS NOT NULL AND cc IS NOT NULL").groupBy("code", "cc").agg(F.min_by(F.struct("place", "lat", "lon"), "seq").alias("x"))
    return first.select("code", "x.place", "x.lat", "x.lon", "cc")


def short_codes(codes: DataFrame, most: int = 4) -> DataFrame:
    """Countries whose longest postal code has ``most`` characters or fewer: ``cc``, ``length``."""
    return codes.groupBy("cc").agg(F.max(F.length("code")).alias("length")).where(F.col("length") <= most)


def without(countries: DataFrame, fine: DataFrame, key: str = "cc") -> DataFrame:
    """The countries that are not in another table."""
    return countries.select(key).distinct().join(fine.select(key), key, "left_anti")


def cached_places(cache: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers of a geocoder (``key`` as city|country, ``lat``, ``lon``, ``display``, ``seq``) as lookups by city and country, and by city alone.

    The country is given as a code; without one, the last part of the answer's
    address tells it. Of several answers the first counts; those without a
    point don't.
    """
    known = cache.where("lat IS NOT NULL").withColumns({"city": F.lower(F.trim(F.substring_index("key", "|", 1))), "__land": F.when(F.contains("key", F.lit("|")), F.expr("substring(key, instr(key, '|') + 1)")).otherwise("")})
    known = geo.country_code(known, "__land", names, "cc").withColumn("__far", F.substring_index(_text("display"), ",", -1))
    known = geo.country_code(known, "__far", names, "__cc").withColumn("shown", F.when(F.col("cc") == "", F.col("__cc")).otherwise(F.col("cc")))
    first = lambda *keys: known.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon", "shown"), "seq").alias("x"))
    return first("city", "cc").select("city", "cc", "x.lat", "x.lon"), first("city").select("city", "x.lat", "x.lon", F.col("x.shown").alias("cc"))


# --- the lookup in tiers


def located(entities: DataFrame, codes: DataFrame, cache: tuple[DataFrame, DataFrame], places: DataFrame, boxes: DataFrame, doubtful: DataFrame | None = None) -> DataFrame:
    """Entities with the point of the first tier that knows them, as ``lat``, ``lon``, ``country`` and ``tier``.

    Tiers: postal code and country; a code that one country only has, which
    fills the country; the cache by city and country; by city alone, which
    fills the country too; the gazetteer by the fold of the city and the country
    found so far; the source's own point, if it is no point that many places
    share (``doubtful``: lat, lon to four decimals) and fits the country's box.
    """
    cached, by_city = cache
    asked = {"__code": F.replace(F.trim(_text("postcode")), F.lit(" "), F.lit("")), "__said": F.trim(_text("country")), "__town": _text("city")}
    rows = entities.withColumns(asked)
    # Each different question is looked up once; a question that very many rows have meets them in one join, which can be split.
    keys = rows.select(*asked).distinct().withColumns({"__land": F.col("__said"), "__city": F.lower(F.trim("__town")), "__fold": text.fold("__town")})
    code = codes.groupBy(F.col("code").alias("__code"), F.col("cc").alias("__land")).agg(F.min_by(F.struct("lat", "lon"), "cc").alias("__t0"))
    only = codes.groupBy(F.col("code").alias("__code")).agg(F.min_by(F.struct("lat", "lon", "cc"), "cc").alias("__t1"), F.min("cc").alias("__a"), F.max("cc").alias("__z")).where("__a = __z").drop("__a", "__z")
    blank = F.col("__code") == ""
    keys = keys.join(code, ["__code", "__land"], "left").join(only, "__code", "left").withColumns({"__t0": F.when(~blank, F.col("__t0")), "__t1": F.when(~blank, F.col("__t1"))})
    keys = keys.withColumn("__land", F.when(F.col("__t0").isNull() & F.col("__t1").isNotNull() & (F.col("__land") == ""), F.col("__t1.cc")).otherwise(F.col("__land")))
    with_land = cached.select(F.col("city").alias("__city"), F.col("cc").alias("__land"), F.struct("lat", "lon").alias("__t2"))
    any_land = by_city.select(F.col("city").alias("__city"), F.struct("lat", "lon", "cc").alias("__t3"))
    early = F.col("__t0").isNotNull() | F.col("__t1").isNotNull()
    keys = keys.join(with_land, ["__city", "__land"], "left").join(any_land, "__city", "left")
    keys = keys.withColumns({"__t2": F.when(~early & (F.col("__land") != ""), F.col("__t2")), "__t3": F.when(~early & (F.col("__city") != ""), F.col("__t3"))})
    keys = keys.withColumn("__t3", F.when(F.col("__t2").isNull(), F.col("__t3")))
    keys = keys.withColumn("__land", F.when((F.col("__land") == "") & F.col("__t3").isNotNull(), F.col("__t3.cc")).otherwise(F.col("__land")))
    named = places.groupBy(text.fold("name").alias("__fold"), F.col("cc").alias("__land")).agg(F.max_by(F.struct("lat", "lon"), F.coalesce("population", F.lit(0))).alias("__t4"))
    keys = keys.join(named, ["__fold", "__land"], "left").withColumn("__t4", F.when((F.col("__city") != "") & (F.col("__land") != ""), F.col("__t4")))
    keys = keys.join(boxes.select(F.col("code").alias("__land"), F.col("box").alias("__box")), "__land", "left")
    tiers = [("postcode", "__t0"), ("only postcode", "__t1"), ("cache", "__t2"), ("cached city", "__t3"), ("gazetteer", "__t4")]
    found = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.lat").alias("lat"), F.col(f"{c}.lon").alias("lon"), F.lit(name).alias("tier"))) for name, c in tiers))
    rows = rows.join(keys.select(*asked, "__land", "__box", found.alias("__found")), list(asked), "left")
    own = geo.in_box(F.col("lat"), F.col("lon"), F.col("__box"), geo.OWN_POINT_MARGIN)
    if doubtful is not None:
        rows = rows.withColumns({"__a": F.round("lat", 4), "__b": F.round("lon", 4)}).join(doubtful.select(F.col("lat").alias("__a"), F.col("lon").alias("__b"), F.lit(True).alias("__shared")), ["__a", "__b"], "left")
        own = own & F.col("__shared").isNull()
    rows = rows.withColumn("__x", F.coalesce("__found", F.when(own, F.struct("lat", "lon", F.lit("own").alias("tier")))))
    return rows.select(*(c for c in entities.columns if c not in ("lat", "lon", "country")), "__x.lat", "__x.lon", F.col("__land").alias("country"), "__x.tier")


def tier_counts(found: DataFrame) -> DataFrame:
    """How many entities each tier placed: ``tier`` (null: nowhere), ``n``."""
    return found.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


# --- a user's home


POSTAL = r"^\s*(\d{4,5})\b\s*([A-Za-zÄÖÜäöü].*)?$"


def home(asked: DataFrame, codes: DataFrame, places: DataFrame) -> DataFrame:
    """The place that a text (``q``) means: ``q``, ``lat``, ``lon``, ``country``, ``label``, ``others``.

    A postal code counts first, with a country code or the beginning of its
    place behind it; ``others`` is how many of that code lie in other
    countries. Else the gazetteer's most populous place of that name or, if
    none has it, the most populous that begins so; ``others`` counts the rest.
    Texts that mean nothing have no row. ``codes`` has (code, place, lat, lon,
    cc, seq), ``places`` (name, lat, lon, cc, population).
    """
    q = asked.select("q").distinct().withColumns({"__code": F.regexp_extract("q", POSTAL, 1), "__rest": finding.typed(F.regexp_extract("q", POSTAL, 2)), "__fold": finding.typed("q")})
    lands = codes.select(F.lower("cc").alias("__rest"), F.lit(True).alias("__is_land")).distinct()
    q = q.join(lands, "__rest", "left").withColumn("__is_land", F.coalesce("__is_land", F.lit(False)))
    # Letters behind a code that are no country make it a code of another kind.
    asked_code = q.where((F.col("__code") != "") & (F.col("__is_land") | ~F.col("__rest").rlike("^[a-z]{1,3}$")))
    hit = asked_code.join(codes.select(F.col("code").alias("__code"), "place", "lat", "lon", "cc", "seq"), "__code").where(~F.col("__is_land") | (F.lower("cc") == F.col("__rest")))
    fits = (F.col("__rest") != "") & ~F.col("__is_land") & text.fold("place").startswith(F.col("__rest"))
    picked = hit.groupBy("q", "__code").agg(F.min_by(F.struct("place", "lat", "lon", "cc"), F.struct(~fits, "seq")).alias("x"), F.collect_list("cc").alias("lands"))
    by_code = picked.select("q", "x.lat", "x.lon", F.col("x.cc").alias("country"), F.concat(F.col("__code"), F.lit(" "), F.col("x.place"), F.lit(" ("), F.col("x.cc"), F.lit(")")).alias("label"), F.size(F.filter("lands", lambda c: c != F.col("x.cc"))).alias("others"))
    named = places.withColumn("__name", text.fold("name")).where("__name <> ''")
    open_ = q.join(by_code.select("q"), "q", "left_anti").where("__fold <> ''")
    # Names meet by the longest of their indexed beginnings.
    met = finding.beginning_with(open_.select("q", F.col("__fold").alias("q_fold")), named.withColumnRenamed("__name", "name_fold"))
    every = met.select("q", (F.col("name_fold") != F.col("q_fold")).cast("int").alias("kind"), "name", "lat", "lon", "cc", "population")
    chosen = every.groupBy("q").agg(F.min_by(F.struct("name", "lat", "lon", "cc"), F.struct("kind", -F.coalesce("population", F.lit(0)), "name", "cc")).alias("x"), (F.count(F.lit(1)) - 1).cast("int").alias("others"))
    return by_code.unionByName(chosen.select("q", "x.lat", "x.lon", F.col("x.cc").alias("country"), F.concat("x.name", F.lit(" ("), F.col("x.cc"), F.lit(")")).alias("label"), "others"))


# --- pins and outlines


def nearest_pin(pins: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The pin (``id``, ``x``, ``y``) nearest to a point of the screen, if it lies within ``radius``."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    return pins.withColumn("d2", d2).where(F.col("d2") < radius * radius).agg(F.min_by("id", F.struct("d2", "id")).alias("id")).where("id IS NOT NULL")


def rings(shapes: DataFrame, json: str = "geometry") -> DataFrame:
    """Outlines of polygons and multipolygons in GeoJSON geometries (a text column): ``ring`` (array of [lon, lat]) with the other columns."""
    kind = F.get_json_object(json, "$.type")
    one = F.from_json(F.get_json_object(json, "$.coordinates"), "array<array<array<double>>>")
    many = F.from_json(F.get_json_object(json, "$.coordinates"), "array<array<array<array<double>>>>")
    every = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.flatten(many)).otherwise(F.array().cast("array<array<array<double>>>"))
    return shapes.select(*(c for c in shapes.columns if c != json), F.explode(every).alias("ring"))


def largest_first(outlines: DataFrame) -> DataFrame:
    """Outlines with the most points first."""
    return outlines.orderBy(F.desc(F.size("ring")))


def in_view(ring: Column, view: tuple[float, float, float, float]) -> Column:
    """Whether an outline's box meets a view (least and most latitude, least and most longitude)."""
    own = geo.ring_box(ring)
    return (own[0] <= view[1]) & (own[1] >= view[0]) & (own[2] <= view[3]) & (own[3] >= view[2])


def ambiguous(found: DataFrame, key: str) -> DataFrame:
    """Add how many other rows have the same key."""
    return found.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy(key)) - 1)
