"""Dates in the ways that sources write them; a date that does not exist is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by the first three letters of their German and English names.
MONTHS = {
    "jan": 1, "feb": 2, "mae": 3, "mär": 3, "mar": 3, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}
# The two orders of English dates.
MONTH_FIRST = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s*(\d{4})"
DAY_FIRST = r"^(\d{1,2})\.?\s+([A-Za-z]{3,9})\.?\s+(\d{4})"


def _trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts as text. try_to_date gives null for the 31st of February, where make_date would fail."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def month_number(c: Column | str) -> Column:
    """Month of a name, written out or short, 0 if it is none."""
    names = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    key = F.substring(F.regexp_replace(F.lower(_trimmed(c)), r"^[. ]+|[. ]+$", ""), 1, 3)
    return F.coalesce(F.try_element_at(names, key), F.lit(0))


def _parts(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    y, m, d = (F.regexp_extract(text, pattern, k) for k in order)
    return F.when(y != "", _made(y, m, d))


def from_iso(c: Column | str) -> Column:
    """2026-08-19, with or without leading zeros or a time after it."""
    return _parts(_trimmed(c), r"^(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3))


def from_german(c: Column | str) -> Column:
    """19.08.2026, with a blank after the first dot if need be."""
    return _parts(_trimmed(c), r"^(\d{1,2})\.\s?(\d{1,2})\.(\d{4})", (3, 2, 1))


def from_english(c: Column | str) -> Column:
    """August 19, 2026 or 19 Aug 2026, month names in German too."""
    t = _trimmed(c)
    out = None
    for pattern, m, d in ((MONTH_FIRST, 1, 2), (DAY_FIRST, 2, 1)):
        month = month_number(F.regexp_extract(t, pattern, m)).cast("string")
        one = _made(F.regexp_extract(t, pattern, 3), month, F.regexp_extract(t, pattern, d))
        out = F.when(t.rlike(pattern), one) if out is None else out.when(t.rlike(pattern), one)
    return out


def from_short(c: Column | str) -> Column:
    """27-Aug-26, of this century."""
    t, pattern = _trimmed(c), r"^(\d{1,2})-([A-Za-z]{3})-(\d{2})$"
    month = month_number(F.regexp_extract(t, pattern, 2)).cast("string")
    return F.when(t.rlike(pattern), _made(F.concat(F.lit("20"), F.regexp_extract(t, pattern, 3)), month, F.regexp_extract(t, pattern, 1)))


def german(c: Column | str) -> Column:
    """19.08.2026; empty without a date."""
    return F.coalesce(F.date_format(c, "dd.MM.yyyy"), F.lit(""))


def iso(c: Column | str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def year_text(c: Column | str) -> Column:
    return F.coalesce(F.year(c).cast("string"), F.lit(""))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two closed spans share a day; a missing end is the start, a missing start shares nothing."""
    return F.coalesce((start_a <= F.coalesce(end_b, start_b)) & (start_b <= F.coalesce(end_a, start_a)), F.lit(False))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def age_in_days(stamp: Column | str, today: Column, unreadable: int | None = None) -> Column:
    """Days since an ISO stamp; ``unreadable`` for what is no date."""
    age = F.datediff(today, from_iso(stamp))
    return age if unreadable is None else F.coalesce(age, F.lit(unreadable))


def range_of_year(ranges: Column, year: Column) -> Column:
    """Of an array of (start, end), the first that starts in the year; the first of all without a year; else null."""
    same = F.filter(ranges, lambda r: F.year(r["start"]) == year)
    return F.when(year.isNull(), F.try_element_at(ranges, F.lit(1))).otherwise(F.try_element_at(same, F.lit(1)))


def first_of_month(c: Column | str) -> Column:
    return F.trunc(c, "MM")
