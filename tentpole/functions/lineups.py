"""Running texts of acts to arrays, and the labels of an entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tentpole.functions.text import _text, clean, collapsed, valid_band

# Labels that end a line-up, and what stands between two acts of a timetable.
TRAILER = r"(?U)\s*(?:Neues zu:|Kommentare zu:|Zurück\b|Zum Festivalplaner|\bclose\b|Kategorie:|Preis:|Besucher:|Location:|Stil:|Plz:|Ort:|Strasse:|Land:|Website:)"
TIME = r"(?U)\b\d{1,2}[:.]\d{2}\s*(?:Uhr)?\s*"
#: Name and style in brackets; both bounded, so that a long text without brackets costs no more than its length.
STYLED = r"([^()]{1,80}?)\s*\(([^()]{2,60})\)"
#: Longest act that is told apart by brackets or times; longest text, in characters and words, that is one act by itself.
LONGEST, ALONE_CHARS, ALONE_WORDS = 60, 30, 4


def _acts(parts: Column, most: int | None = None) -> Column:
    short = (lambda x: F.length(x) <= most) if most else (lambda x: F.lit(True))
    return F.filter(F.transform(parts, collapsed), lambda x: valid_band_of_clean(x) & short(x))


def valid_band_of_clean(c: Column) -> Column:
    """:func:`tentpole.functions.text.valid_band` for text that is clean already, so that it can stand in a lambda."""
    return valid_band(c, cleaned=True)


def acts(c: Column | str, cleaned: bool = False) -> Column:
    """Acts of a running text, without guessing.

    The text ends at the first label of another field. Separators are commas;
    without any, two styles in brackets or more; then two times or more. Short
    text without separator is one act; anything else none. Null and empty text
    has no acts. ``cleaned`` says that the text is clean already.
    """
    t = F.trim(F.element_at(F.split(_text(c) if cleaned else clean(c), TRAILER), 1))
    by_comma = _acts(F.split(t, ","))
    styles = F.regexp_extract_all(t, F.lit(STYLED), F.lit(1))
    after = F.element_at(F.split(t, r"\)"), -1)
    by_style = _acts(F.array_append(styles, after), LONGEST)
    by_time = _acts(F.split(t, TIME), LONGEST)
    alone = valid_band_of_clean(t) & (F.length(t) <= ALONE_CHARS) & (F.size(F.split(t, " ")) <= ALONE_WORDS)
    return (
        F.when(t == "", F.array().cast("array<string>"))
        .when(t.contains(","), by_comma)
        .when(t.contains("(") & (F.size(styles) >= 2) & (F.size(by_style) >= 2), by_style)
        .when((F.regexp_count(t, F.lit(TIME)) >= 2) & (F.size(by_time) >= 2), by_time)
        .when(alone, F.array(t))
        .otherwise(F.array().cast("array<string>"))
    )


def location(city: Column | str, country: Column | str) -> Column:
    """City and country as far as they are known, joined by ``", "``."""
    return F.concat_ws(", ", F.nullif(_text(city), F.lit("")), F.nullif(_text(country), F.lit("")))


def link_target(c: Column | str) -> Column:
    """Where a forwarding link leads: its first parameter ``url``, ``u``, ``link`` or ``goto`` that is not empty; else the link itself."""
    t = _text(c)
    inner = (F.nullif(F.try_url_decode(F.regexp_extract(t, rf"[?&]{p}=([^&#]*)", 1)), F.lit("")) for p in ("url", "u", "link", "goto"))
    return F.coalesce(*inner, t)
