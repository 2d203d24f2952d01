"""The faceted search: filters, funnel counts, match score, order, top hits.

Entities have the columns name, start, end, cancelled, lat, lon, eur, bands
(array of text) and genres (array of text). A search is a parameter object that
is compiled to column expressions; Spark combines the filters and takes the top
hits without a full sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tentpole.functions.geo import distance_km
from tentpole.functions.money import to_euro
from tentpole.functions.text import fold
from tentpole.operators import cells, finding

#: Hits that a search returns at most.
TOP = 300
#: What decides among hits, by sort; missing values come last.
ORDERS = {"match": ["pct", "km", "start", "eur"], "distance": ["km", "start", "eur"], "price": ["eur", "km", "start"], "date": ["start", "km", "eur"]}


@dataclass(frozen=True)
class Search:
    """What a user asks for.

    The time always counts: cancelled and undated entities are asked for. Of
    distance and price, ``distance_on`` and ``price_on`` say whether the step
    counts (None: if a bound is given); then places and prices that are unknown
    are asked for, with bounds or without.
    """

    start: date | None = None
    end: date | None = None
    undated: bool = False
    cancelled: bool = False
    home: tuple[float, float] | None = None
    km_min: float = 0
    km_max: float | None = None
    distance_on: bool | None = None
    no_place: bool = False
    price_min: float | None = None
    price_max: float | None = None
    price_on: bool | None = None
    currency: str = "EUR"
    no_price: bool = True
    bands: dict[str, float] = field(default_factory=dict)
    genres: tuple[str, ...] = ()
    no_genre: bool = False
    sort: str | None = None

    def uses_distance(self) -> bool:
        """Whether the distance counts; never without a home."""
        bounded = self.km_max is not None or self.km_min > 0
        return self.home is not None and (bounded if self.distance_on is None else self.distance_on)

    def uses_price(self) -> bool:
        bounded = self.price_min is not None or self.price_max is not None
        return bounded if self.price_on is None else self.price_on

    def sorts(self) -> list[str]:
        """Sorts that can order anything."""
        return [*(["match"] if self.bands or self.genres else []), *(["distance"] if self.home else []), "date", "price"]

    def order(self) -> str:
        """The chosen sort if it is possible, else the first that is."""
        return self.sort if self.sort in self.sorts() else self.sorts()[0]


def km(search: Search) -> Column:
    """Distance from home in whole kilometres; null without home or place."""
    if search.home is None:
        return F.lit(None).cast("double")
    return F.round(distance_km(*(F.lit(float(x)) for x in search.home), F.col("lat"), F.col("lon")))


def _known_or(c: Column, inside: Column, otherwise: bool) -> Column:
    return F.when(c.isNull(), F.lit(otherwise)).otherwise(inside)


def steps(search: Search, columns: list[str] = ()) -> list[tuple[str, Column]]:
    """The six filters in order; one that is not in use holds for all, as the place always does: it only measures.

    ``columns`` are those that the entities have: with ``km`` the distance is
    not computed again, with ``band_weight`` no array of bands is needed.
    """
    always = F.lit(True)
    hidden = F.coalesce(F.col("cancelled"), F.lit(False)) & F.lit(not search.cancelled)
    in_time = F.lit(True)
    if search.start is not None:
        in_time = in_time & (F.coalesce("end", "start") >= F.lit(search.start))
    if search.end is not None:
        in_time = in_time & (F.col("start") <= F.lit(search.end))
    time = ~hidden & _known_or(F.col("start"), in_time, search.undated)
    place = always
    if search.uses_distance():
        d = km(search) if "km" not in columns else F.col("km")
        near = (d >= search.km_min) & (F.lit(True) if search.km_max is None else d <= search.km_max)
        place = _known_or(d, near, search.no_place)
    price = always
    if search.uses_price():
        low, high = search.price_min, search.price_max
        fits = (F.lit(True) if low is None else F.col("eur") >= to_euro(low, search.currency)) & (F.lit(True) if high is None else F.col("eur") <= to_euro(high, search.currency))
        price = _known_or(F.col("eur"), fits, search.no_price)
    texts = lambda xs: F.array(*(F.lit(x) for x in xs))
    has = F.col("band_weight").isNotNull() if "band_weight" in columns else F.coalesce(F.arrays_overlap("bands", texts(search.bands or [""])), F.lit(False))
    bands = has if search.bands else always
    genres = always
    if search.genres:
        none = F.coalesce(F.size("genres"), F.lit(0)) <= 0
        genres = F.when(none, F.lit(search.no_genre)).otherwise(F.coalesce(F.arrays_overlap("genres", texts(search.genres)), F.lit(False)))
    return [("place", always), ("time", time), ("distance", place), ("price", price), ("bands", bands), ("genre", genres)]


def with_bands(entities: DataFrame, members: DataFrame, search: Search, id: str = "id") -> DataFrame:
    """Add ``band_weight``: the weights of the chosen bands that an entity has, null if none.

    ``members`` has a row for each entity (``id``) and act (``band``), repeats
    allowed. Only rows of chosen bands leave its scan, and no line-up is built.
    """
    if not search.bands:
        return entities.withColumn("band_weight", F.lit(None).cast("double"))
    weight = F.coalesce(*(F.when(F.col("band") == b, F.lit(float(w))) for b, w in search.bands.items()))
    chosen = members.where(F.col("band").isin(list(search.bands))).select(id, "band", weight.alias("__w")).distinct()
    return entities.join(chosen.groupBy(id).agg(F.sum("__w").alias("band_weight")), id, "left")


def percent(search: Search, columns: list[str] = ()) -> Column:
    """Mean of the shares of the chosen bands' weights and of the chosen genres that an entity has.

    The genres count only if there is a hit; null if nothing counts.
    """
    shares = []
    if search.bands:
        total = float(sum(search.bands.values()))
        have = F.col("band_weight") if "band_weight" in columns else sum((F.when(F.array_contains("bands", b), F.lit(float(w))).otherwise(F.lit(0.0)) for b, w in search.bands.items()), F.lit(0.0))
        shares.append(F.coalesce(have, F.lit(0.0)) / total * 100)
    if search.genres:
        hits = F.size(F.array_intersect("genres", F.array(*(F.lit(g) for g in search.genres))))
        shares.append(F.when(hits > 0, hits / len(search.genres) * 100))
    if not shares:
        return F.lit(None).cast("double")
    every = F.array_compact(F.array(*shares))
    return F.when(F.size(every) > 0, F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / F.size(every))


def hits(entities: DataFrame, search: Search, top: int = TOP, page: int = 0, per_page: int | None = None) -> DataFrame:
    """The first ``top`` entities that pass all filters, with ``km`` and ``pct``; ties by name, then id if there is one.

    With ``per_page``, only that page of them, the first being 0.
    """
    if "cell" in entities.columns and search.uses_distance() and search.km_max is not None:
        # Stored by :func:`tentpole.operators.cells.stored`: only what lies around is read. Distances are rounded to whole kilometres.
        entities = entities.where(cells.touched(search.home, search.km_max + 1, search.no_place)).drop("cell")
    out = entities.withColumn("km", km(search))
    columns = out.columns
    for _, condition in steps(search, columns):
        out = out.where(condition)
    out = out.withColumn("pct", percent(search, columns)).drop("band_weight")
    by = [F.desc_nulls_last(c) if c == "pct" else F.asc_nulls_last(c) for c in ORDERS[search.order()]]
    out = out.orderBy(*by, "name", *(["id"] if "id" in entities.columns else [])).limit(top)
    return out if per_page is None else out.offset(page * per_page).limit(per_page)


def funnel(entities: DataFrame, search: Search) -> DataFrame:
    """How many entities pass the first k filters, for every k, in one pass: ``step``, ``n``."""
    out = entities.withColumn("km", km(search))
    passed, columns, names = F.lit(True), [], []
    for name, condition in steps(search, out.columns):
        passed = passed & condition
        columns.append(F.count_if(passed).alias(name))
        names.append(name)
    pairs = F.array(*(F.struct(F.lit(n).alias("step"), F.col(n).alias("n")) for n in names))
    return out.agg(*columns).select(F.explode(pairs).alias("x")).select("x.step", "x.n")


def names_with(names: DataFrame, text: str, top: int = 80) -> DataFrame:
    """Names (``name``, ``n``) whose fold contains that of a text of two letters or more, the most frequent first.

    One text against all names, in one scan; for many texts see
    :func:`tentpole.operators.finding.names_containing`.
    """
    wanted = finding.typed(F.lit(text))
    return names.where((F.length(wanted) >= finding.LEAST) & F.contains(fold("name"), wanted)).orderBy(F.desc("n"), "name").limit(top)


def clamped(search: Search, earliest: date | None = None) -> Search:
    """A search with its bounds in order: a start before ``earliest`` is that day, reversed dates change places, negative bounds are none."""
    start, end = search.start, search.end
    if start is not None and earliest is not None and start < earliest:
        start = earliest
    if start is not None and end is not None and end < start:
        start, end = end, start
    positive = lambda x: x if x is not None and x >= 0 else None
    return replace(search, start=start, end=end, km_min=positive(search.km_min) or 0, km_max=positive(search.km_max), price_min=positive(search.price_min), price_max=positive(search.price_max))


def hints(search: Search, today: date, earliest: date | None = None) -> list[str]:
    """What is odd about a search: ``km-reversed``, ``price-reversed``, ``past``, ``too-early``, and the price bounds in euro if they are in another currency."""
    out = []
    if search.km_max is not None and 0 <= search.km_max < search.km_min:
        out.append("km-reversed")
    if None not in (search.price_min, search.price_max) and search.price_max < search.price_min:
        out.append("price-reversed")
    if search.end is not None and search.end < today:
        out.append("past")
    if search.start is not None and earliest is not None and search.start < earliest:
        out.append("too-early")
    if search.currency != "EUR":
        out += [f"eur:{to_euro(x, search.currency):.2f}" for x in (search.price_min, search.price_max) if x is not None]
    return out
