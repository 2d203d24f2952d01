"""Text normalisation and comparison keys, as column expressions.

Only what Spark has no function for (character references, compatibility
decomposition) runs in Python, in Arrow batches; everything after that is
native. Null text counts as empty everywhere.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The folding rules that comparison keys depend on.
SPECIAL_LETTERS = [("ß", "ss"), ("ø", "o"), ("æ", "ae"), ("œ", "oe"), ("đ", "d"), ("ħ", "h"), ("ł", "l"), ("ı", "i"), ("þ", "th"), ("ð", "d")]
REPLACEMENTS = [("&", " and "), ("+", " and "), ("’", "'"), ("´", "'"), ("`", "'"), ("–", "-"), ("—", "-"), ("…", "")]
CONNECTORS = ["feat", "ft", "featuring", "vs", "with", "und", "and"]
ARTICLES = ["the", "die", "der", "das", "los", "las", "les"]
ADDITIONS = ["band", "live", "dj ?set", "djset", "acoustic"]
# Invisible characters that become blanks.
INVISIBLE = "[ ​-‏  ‪-‮﻿]"
# Texts that are no band name.
FILLERS = r"uvm|u\.v\.m\.|und viele mehr|alle artists|t\.b\.a\.?|tba|mehr|close|line ?-?up|weitere|special guest[s]?|support|n/a|-{1,3}"
FIELD_RESIDUE = r"\b(?:VVK|AK|Camping|Rahmenprogramm|zum kompletten Programm)\b|\b(?:Kategorie|Preis|Besucher|Stil|Location)\s*:"
SENTENCE_WORDS = r"\b(?:ist|sind|wird|werden|findet|treffen|startet|sorgen|bestätigt|außerdem)\b"
BUTTONS = r"(?i)^(?:tickets?\b|get |buy |mehr\b|more |website\b|infos?\b|hier\b)"
POSTCODE_FIRST = r"^(\d{3,5}(?:\s?\d{2})?)\s+(?=\D)"

#: White space as Python's and Java's Unicode classes see it alike.
SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: A character reference that ends with a semicolon.
_CLOSED = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


@F.pandas_udf(StringType())
def _unescaped_closed(s: pd.Series) -> pd.Series:
    of = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])
    return s.map(lambda x: _CLOSED.sub(of, x), na_action="ignore")


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c)), na_action="ignore")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df.withColumns``, but a row's values are computed once: Spark copies the expressions of plain columns into all filters and columns that use them."""
    kept = [c for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))).alias("__one")
    return df.select(*kept, one).select(*kept, "__one.*")


def collapsed(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def decoded(c: Column | str, closed: bool = False) -> Column:
    """Character references decoded, with ``closed`` only those that end with a semicolon. Texts without ``&`` never leave the JVM's fast path: Python sees a null."""
    t = _text(c)
    return F.coalesce((_unescaped_closed if closed else _unescaped)(F.when(t.contains("&"), t)), t)


def clean(c: Column | str, closed: bool = False) -> Column:
    """One line: character references decoded (as :func:`decoded`), invisible characters and white space runs as one blank, trimmed."""
    return collapsed(F.regexp_replace(decoded(c, closed), INVISIBLE, " "))


def cleaned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df.withColumns`` with :func:`clean` of each value, which is worked out first, since the steps of cleaning ask for it again and again."""
    return worked_out(worked_out(df, columns), {n: clean(F.col(n)) for n in columns})


def fold(c: Column | str, decode: bool = True) -> Column:
    """Comparison key of a name: letters and digits of any script, without case, marks, connecting words, one leading article and one trailing addition.

    Only texts with a character outside ASCII are decomposed in Python. What a
    user types has no character references to ``decode``.
    """
    t = clean(c) if decode else collapsed(F.regexp_replace(_text(c), INVISIBLE, " "))
    v = F.coalesce(_decomposed(F.when(t.rlike(r"[^\x00-\x7F]"), t)), F.lower(t))
    for old, new in SPECIAL_LETTERS + REPLACEMENTS:
        v = F.replace(v, F.lit(old), F.lit(new))
    v = F.regexp_replace(v, rf"(?U)\b({'|'.join(CONNECTORS)})\b", " and ")
    v = F.trim(F.regexp_replace(v, r"[^\p{L}\p{N}]+", " "))
    v = F.regexp_replace(v, rf"^({'|'.join(ARTICLES)})\s+", "")
    return F.trim(F.regexp_replace(v, rf"\s+({'|'.join(ADDITIONS)})$", ""))


def joined(key: Column) -> Column:
    """A folded name without blanks if five characters or more are left; short names stay apart."""
    return let(key, lambda k: F.when(F.length(F.replace(k, F.lit(" "), F.lit(""))) >= 5, F.replace(k, F.lit(" "), F.lit(""))).otherwise(k))


def with_band_key(df: DataFrame, column: str, aliases: DataFrame, out: str = "band_key") -> DataFrame:
    """Add the key of an act: the fold of its name, or of the full name that it is short for (``aliases``: short, full), without blanks if long enough."""
    known = aliases.select(fold("short").alias("__short"), fold("full").alias("__full")).groupBy("__short").agg(F.min("__full").alias("__full"))
    rows = df.withColumn("__fold", fold(column)).join(known, F.col("__fold") == F.col("__short"), "left")
    return rows.withColumn("__key", F.coalesce("__full", "__fold")).withColumn(out, joined(F.col("__key"))).drop("__fold", "__short", "__full", "__key")


def with_preferred_name(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace a name by the preferred one for its fold (``aliases``: variant, preferred)."""
    known = aliases.select(fold("variant").alias("__variant"), "preferred").groupBy("__variant").agg(F.min("preferred").alias("__preferred"))
    rows = df.withColumn("__fold", fold(column)).join(known, F.col("__fold") == F.col("__variant"), "left")
    return rows.withColumn(column, F.coalesce("__preferred", column)).drop("__fold", "__variant", "__preferred")


def event_key_of_fold(folded: Column) -> Column:
    """Key of an event name from its fold: years and the words for festival go, unless nothing would be left."""

    def stripped(v: Column) -> Column:
        v = F.regexp_replace(v, r"(?U)\b(19|20)\d{2}\b", " ")
        v = F.regexp_replace(v, r"(?U)\b(festival|fest|open air|openair|open|air)\b", " ")
        v = F.regexp_replace(v, r"(?U)(?<=\w{4})(festival|openair|fest)\b", " ")
        return collapsed(F.regexp_replace(v, r"(?U)\b(festival|openair)(?=\w{4})", " "))

    return let(folded, lambda k: F.coalesce(F.nullif(stripped(k), F.lit("")), k))


def event_key(c: Column | str) -> Column:
    return event_key_of_fold(fold(c))


def tight_key(c: Column | str) -> Column:
    """Event key without blanks."""
    return F.replace(event_key(c), F.lit(" "), F.lit(""))


def city_key(c: Column | str) -> Column:
    """Fold of a place name without its postal code."""
    return fold(F.regexp_replace(_text(c), r"(?U)\b\d{4,6}\b", " "))


def valid_band(c: Column | str, cleaned: bool = False) -> Column:
    """Whether a text can be a band's name rather than a piece of a sentence or field; ``cleaned`` says that it is clean already."""
    n = _text(c) if cleaned else clean(c)
    return (
        F.length(n).between(2, 90)
        & ~n.rlike(rf"(?iU)^({FILLERS})$")
        & ~n.rlike(r"(?U)^\d{1,2}\.\s?\d{1,2}\.\d{2,4}\b")
        & ~n.rlike(rf"(?iU){FIELD_RESIDUE}")
        & n.rlike(r"[\p{L}\p{N}]")
        & ~((F.size(F.split(n, " ")) >= 6) & n.rlike(rf"(?iU){SENTENCE_WORDS}"))
    )


def is_button(c: Column | str) -> Column:
    """Whether a venue is the label of a button."""
    return _text(c).rlike(BUTTONS)


def visitors(c: Column | str) -> Column:
    """The one number in a text as digits, if from 10 to 5,000,000; else empty."""
    numbers = F.filter(F.transform(F.regexp_extract_all(clean(c), F.lit(r"\d[\d.\s']*\d|\d"), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", "")), lambda x: x != "")
    n = F.try_element_at(numbers, F.lit(1)).try_cast("decimal(38,0)")
    return F.coalesce(F.when((F.size(numbers) == 1) & n.between(10, 5_000_000), n.cast("string")), F.lit(""))


def postcode_and_city(city: Column | str, postcode: Column | str) -> tuple[Column, Column]:
    """(city, postal code): a code before the city's name moves to the code unless there is one."""
    place, code = clean(city), clean(postcode)
    found = F.regexp_extract(place, POSTCODE_FIRST, 1)
    return (
        F.when(found != "", F.trim(F.regexp_replace(place, POSTCODE_FIRST, ""))).otherwise(place),
        F.when((found != "") & (code == ""), F.replace(found, F.lit(" "), F.lit(""))).otherwise(code),
    )


def genre_union(*parts: Column | str) -> Column:
    """Genres of several texts, each once without regard to case, in order of first mention, joined by ``", "``."""
    every = F.flatten(F.array(*(F.split(_text(p), ",") for p in parts)))
    names = F.filter(F.transform(every, collapsed), lambda x: x != "")
    first = F.aggregate(names, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.array_append(got, x)))
    return F.array_join(first, ", ")


def website_host(c: Column | str) -> Column:
    """Lower-case host of a URL without ``www.``; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.expr(f"try_parse_url(lower(trim({c})), 'HOST')") if isinstance(c, str) else F.try_parse_url(F.lower(F.trim(c)), F.lit("HOST")), r"^www\.", ""), F.lit(""))


def without_year(c: Column | str) -> Column:
    """A title without a year 20xx at its end, unless nothing would be left."""
    t = _text(c)
    v = F.trim(F.regexp_replace(t, r"\s*\b20\d{2}\b\s*$", ""))
    return F.when(v != "", v).otherwise(t)


def price_residue(c: Column | str) -> Column:
    """What a price text says beside numbers, euro and "from"."""
    v = F.regexp_replace(F.regexp_replace(_text(c), r"\d+(?:[.,]\d+)?", " "), r"(?i)€|\bEUR\b|\bab\b|\bfrom\b", " ")
    return F.trim(F.regexp_replace(v, r"[^\p{L}]+", " "))


def slug(c: Column | str) -> Column:
    """Last part of a URL's path."""
    path = F.regexp_replace(_text(c), r"^[a-zA-Z]+://[^/]*|[?#].*$", "")
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
