"""What can be read from web pages with patterns, and the JSON-LD blocks in them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tentpole.functions.text import SPACE, _text, clean, collapsed, decoded, valid_band, worked_out

# Types of JSON-LD objects that are events.
EVENT_TYPES = ["event", "festival", "musicevent", "musicfestival"]
_BLOCK = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def sitemap(c: Column | str) -> Column:
    """Addresses in a sitemap."""
    return F.regexp_extract_all(_text(c), F.lit(r"<loc>([^<]+)</loc>"), F.lit(1))


def title(c: Column | str, closed: bool = False) -> Column:
    """Cleaned text of a page's title; empty without one. With ``closed`` a character reference without its semicolon, as a title that was cut has it, stays as it stands."""
    return clean(raw_title(c), closed)


def raw_title(c: Column | str) -> Column:
    return F.regexp_extract(_text(c), r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(pages: DataFrame) -> DataFrame:
    """All link targets: ``page_id``, ``pos`` from 0, ``href``."""
    every = F.regexp_extract_all(_text("html"), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(every).alias("pos", "href"))


@F.pandas_udf(ArrayType(StringType()))
def event_objects(pages: pd.Series) -> pd.Series:
    """JSON texts of the event objects in each page's JSON-LD; lists and ``@graph`` are opened, the last element first. Blocks that are no JSON are passed over."""

    def found(page: str | None) -> list[str]:
        out = []
        for block in _BLOCK.findall(page or ""):
            try:
                open_ = [json.loads(block)]
            except ValueError:
                continue
            while open_:
                x = open_.pop()
                if isinstance(x, list):
                    open_ += x
                elif isinstance(x, dict):
                    if str(x.get("@type", "")).lower() in EVENT_TYPES:
                        out.append(json.dumps(x, ensure_ascii=False))
                    if isinstance(x.get("@graph"), list):
                        open_ += x["@graph"]
        return out

    return pages.map(found)


def event_blocks(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``event`` (JSON text) of every event object; pages without the marker never reach Python."""
    some = pages.where(F.contains(F.lower("html"), F.lit("ld+json")))
    return some.select("page_id", F.explode(event_objects("html")).alias("event"))


def first_object(json_text: Column, path: str) -> Column:
    """JSON text at a path that may be an object or a list of them: the first one."""
    return F.coalesce(F.get_json_object(json_text, f"$.{path}[0]"), F.get_json_object(json_text, f"$.{path}"))


#: Stands for a tag while a page becomes text.
_TAG = "\x01"
#: What is no text of a page: comments, declarations, scripts, styles, templates.
_NO_TEXT = r"(?is)<!--.*?-->|<![a-z][^>]*>|<(script|style|template)\b[^>]*>.*?</\1\s*>"


def _marked(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(c), _NO_TEXT, ""), r"<[^>]*>", _TAG)


def _joined(marked: Column, between: str) -> Column:
    # Blanks around tags and tags without text between them are one cut.
    line = F.btrim(F.regexp_replace(decoded(marked), SPACE, " "), F.lit(f" {_TAG}"))
    return F.regexp_replace(line, f" *{_TAG}[ {_TAG}]*", between)


def flat(c: Column | str, between: str = " ") -> Column:
    """The text of a page: every piece of text between tags, cleaned, without empty ones, joined."""
    return _joined(_marked(c), between)


def with_flat(df: DataFrame, out: str = "__flat", c: Column | str = "html", between: str = " ") -> DataFrame:
    """Add :func:`flat` of a page, each of its steps worked out once."""
    return worked_out(worked_out(df, {out: _marked(c)}), {out: _joined(F.col(out), between)})


def plain(c: Column) -> Column:
    """Text of a piece of markup, for use in lambdas: tags go, the five basic character references are decoded."""
    t = F.regexp_replace(c, r"<[^>]*>", "")
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(letter))
    return collapsed(t)


def element(c: Column | str, tag: str) -> Column:
    """Cleaned text of the first element with a tag; empty without one."""
    return clean(raw_element(c, tag))


def raw_element(c: Column | str, tag: str) -> Column:
    return F.regexp_replace(F.regexp_extract(_text(c), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"<[^>]*>", " ")


def anchors(c: Column | str) -> Column:
    """All links with a target in double quotes: array of (href, text, title)."""
    pattern = r'(?is)<a\s(?=[^>]*\bhref="([^"]*)")(?=[^>]*?(?:\btitle="([^"]*)"|>))[^>]*>(.*?)</a\s*>'
    every = [F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(k)) for k in (1, 3, 2)]
    return F.transform(F.arrays_zip(*(e.alias(n) for e, n in zip(every, "htk", strict=True))), lambda x: F.struct(F.trim(x["h"]).alias("href"), plain(x["t"]).alias("text"), x["k"].alias("title")))


def first_link(links: Column, good: Callable[[Column], Column]) -> Column:
    """Target of the first of some links (from :func:`anchors`) for which ``good`` holds; empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(links, good), F.lit(1))["href"], F.lit(""))


def joined_url(base: Column, href: Column) -> Column:
    """A link's target seen from the page it stands on."""
    host = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def performers(told: Column) -> Column:
    """Names of an event object's performers (the JSON text of that field), which are texts or objects, as far as they can be acts."""
    every = F.from_json(told, "array<string>")
    names = F.transform(F.coalesce(every, F.array().cast("array<string>")), lambda x: plain(F.coalesce(F.get_json_object(x, "$.name"), F.when(~x.startswith("{"), x), F.lit(""))))
    return F.filter(names, lambda x: valid_band(x, cleaned=True))
