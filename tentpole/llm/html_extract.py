"""Main text of web pages by consensus: pages of a host vote on the paths of their text containers."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tentpole.llm.common import lookup_join, saved

#: Paths that win on a host, best first: so many templates of one host vote. A page on which none of them occurs uses its own best container, so none is lost by it.
PATHS = 256
#: Characters from which a block counts in full; the longest block of a page always does.
LONG = 120
#: A path that other pages of the host chose too goes first on a page where its own score is at most this far from the best.
CLOSE = 0.3
#: Up to this many bytes of host names and path keys, the winners are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 8_000_000

# Element names of HTML by the part they play here.
RAW = set("script style noscript template textarea iframe svg math object select canvas audio video title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("html body div main article section td table tbody tr center content blockquote figure details fieldset ul ol dl".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd th pre header footer nav aside form hr address figcaption summary head thead tfoot caption menu dialog search hgroup legend".split())
HEADINGS = {f"h{k}" for k in range(1, 7)}
BOILERPLATE_TAGS = set("head nav footer aside button menu search label input".split())
#: Elements that are boilerplate unless the page's text or its article stands in them: some pages are one form or one dialog.
WRAPPER_TAGS = {"form", "dialog"}
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Parts of class names and ids that mark what is no article.
BOILERPLATE_WORDS = set(
    "nav navbar navigation menu submenu footer footnav sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended recommendation recommendations teaser teasers comment comments "
    "commentlist disqus reply replies respond newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget widgets toolbar skip masthead topbar".split()
)
HEADER_WORDS = {"header", "topnav", "siteheader"}
#: With these, a header belongs to the article, and its headings count.
ARTICLE_WORDS = set("post entry article story content title page main".split())
#: A start tag of one of the first closes an open element of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSABLE = {"p"} | HEADINGS | set().union(*CLOSES.values())
#: The end tag of each element whose content is no markup.
END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}

TOKEN = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"]*"|'[^']*')*+)>|(!--)|(/?)([a-zA-Z][^\s/>]*)[^>]*>?|[!?][^>]*>?)""")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
TELLING = re.compile(r"class|id=|hidden|role|style")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True, eq=False)
class Element:
    """An open or closed element. What it needs to know of those around it stands in it, so no step walks upwards.

    ``path`` is a 64-bit key of the generalised names from the root down, chained from that of the parent.
    """

    tag: str
    path: int
    parent: Element | None
    #: 0: may hold text, 1: only headings count (a header), 2: no article text.
    drop: int
    #: Elements above it, and block elements above it (parts of its path).
    depth: int = 0
    level: int = 0
    #: The innermost container, itself included, and the innermost heading below that.
    within: Element | None = None
    heading: str = ""
    #: Whether an article or main element is around it or it is one.
    in_article: bool = False
    #: Of elements that others may close: the outermost open one below the innermost container, by tag.
    outer: dict[str, Element] = field(default_factory=dict)
    #: Boilerplate by class, id or role only, or a form or dialog, which holds unless the element holds most of the page or its article.
    marked: bool = False
    #: The innermost element, itself included, that is marked or an article or main element; None without one.
    special: Element | None = None
    #: Its number among the containers of the page, in order of start tags; -1 if it is none.
    number: int = -1


@dataclass(slots=True)
class Block:
    text: str
    within: Element
    heading: str
    linked: int
    drop: int
    #: The innermost element around the text.
    of: Element


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    containers: list[Element] = field(default_factory=list)
    #: Marked elements, articles and main elements, in order of start tags.
    special: list[Element] = field(default_factory=list)


def _attributes(rest: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


#: Start tags longer than this are not remembered.
LONG_TAG = 500


@lru_cache(maxsize=65_536)
def _chained(path: int, key: str) -> int:
    """The path of an element with a generalised name below another path; the same in every process."""
    return xxh64_intdigest(key, path)


@lru_cache(maxsize=8192)
def _kind(tag: str, rest: str) -> tuple[str, int]:
    """The generalised name of an element, tag and class words (or id) without digits, and 0: plain, 1: header, 2: boilerplate, 4: boilerplate unless it holds the article."""
    attributes = _attributes(rest)
    words = [w.lower() for name in ("class", "id") for w in WORD.findall(attributes.get(name, ""))]
    names = WORD.findall(attributes.get("class", "")) or WORD.findall(attributes.get("id", ""))
    key = tag + "".join(f".{w.lower()}" for w in sorted(set(names))[:4])
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
    whole = tag in ("html", "body", "article", "main")
    if tag in BOILERPLATE_TAGS or hidden:
        return key, 2
    by_role = attributes.get("role", "").lower() in BOILERPLATE_ROLES
    if not whole and tag != "header" and (by_role or tag in WRAPPER_TAGS or not BOILERPLATE_WORDS.isdisjoint(words)):
        return key, 4
    if tag == "header" and (by_role or not BOILERPLATE_WORDS.isdisjoint(words)):
        return key, 2
    if tag == "header" or not whole and tag not in HEADINGS and not HEADER_WORDS.isdisjoint(words):
        return key, 1 if ARTICLE_WORDS.isdisjoint(words) else 3
    return key, 0


def _element(tag: str, rest: str, parent: Element) -> Element:
    """An element below ``parent`` with its path and what of its text may count."""
    block, container = tag in BLOCKS, tag in CONTAINERS
    key, kind = (_kind if len(rest) <= LONG_TAG else _kind.__wrapped__)(tag, rest) if block or TELLING.search(rest) else ("", 0)
    drop = 2 if kind == 2 else 0
    if kind in (1, 3):
        drop = 1 if parent.in_article or kind == 3 else 2
    e = Element(tag, _chained(parent.path, key) if block else parent.path, parent, max(drop, parent.drop), parent.depth + 1, parent.level + block)
    e.marked, whole = kind == 4, tag in ("article", "main")
    e.in_article, e.special = parent.in_article or whole, e if e.marked or whole else parent.special
    if container:
        e.within = e
    else:
        e.within, e.heading = parent.within, tag if tag in HEADINGS else parent.heading
        e.outer = parent.outer if tag not in CLOSABLE or tag in parent.outer else parent.outer | {tag: e}
    return e


def _to_close(tag: str, here: Element) -> Element | None:
    """The outermost open element that a start tag closes: not beyond a container, unless that is to be closed itself."""
    wanted = CLOSES.get(tag, set()) | {"p"} | (HEADINGS if tag in HEADINGS else set())
    until, e = None, here
    while e.parent:
        found = [x for t, x in e.outer.items() if t in wanted]
        until = min(found, key=lambda x: x.depth) if found else until
        if (c := e.within).tag not in wanted:
            break
        until, e = c, c.parent
    return until


def _summed(page: Page, at: dict[int, list[float]], width: int) -> None:
    """Add what stands at each special element to all special elements around it."""
    for e in reversed(page.special):
        if (up := e.parent.special) and id(e) in at:
            above = at.setdefault(id(up), [0] * width)
            for k, x in enumerate(at[id(e)]):
                above[k] += x


def _marks(page: Page) -> None:
    """Drop the blocks in elements named like boilerplate, forms and dialogs, except in those that hold most of the page or its article.

    Such a mark counts for nothing if the element's own text, without what is
    in further such elements, is over half of the page's and no h1 stands
    outside only; or if an article or main element in it holds at least as much
    as all text outside. If nothing but marked text is left, the element with
    an article or main, an h1, or else the most own text counts as plain.
    """
    live = [b for b in page.blocks if is_article(b)]
    if not any(e.marked for e in page.special) or not any(b.of.special for b in live):
        return
    size = [len(b.text) if 2 * b.linked < len(b.text) else 0 for b in live]
    total, titles = sum(size), sum(b.heading == "h1" for b in live)
    # The innermost marked element around each special one, itself included.
    marked: dict[int, Element | None] = {}
    for e in page.special:
        marked[id(e)] = e if e.marked else marked[id(e.parent.special)] if e.parent.special else None
    # In each special element: text, main headings, blocks; and text whose innermost marked element is this one.
    held: dict[int, list[float]] = {}
    net: dict[int, int] = {}
    for n, b in zip(size, live, strict=True):
        if e := b.of.special:
            at = held.setdefault(id(e), [0, 0, 0])
            at[0], at[1], at[2] = at[0] + n, at[1] + (b.heading == "h1"), at[2] + 1
            if m := marked[id(e)]:
                net[id(m)] = net.get(id(m), 0) + n
    _summed(page, held, 3)
    # The most that an article in a marked element holds, if no other marked element stands between.
    main: dict[int, int] = {}
    for e in page.special:
        if not e.marked and id(e) in held and (m := marked[id(e)]):
            main[id(m)] = max(main.get(id(m), 0), held[id(e)][0])
    every = [e for e in page.special if e.marked and id(e) in held]
    for e in sorted(every, key=lambda e: -e.depth):
        i, (text, heads, _) = id(e), held[id(e)]
        own = net.get(i, 0)
        if main.get(i) and main[i] >= total - text or 2 * own > total and (heads or not titles):
            e.marked = False
            if e.parent.special and (outer := marked[id(e.parent.special)]):
                net[id(outer)] = net.get(id(outer), 0) + own

    def covered() -> dict[int, bool]:
        """Whether a marked element is around each special one or it is marked itself."""
        out: dict[int, bool] = {}
        for e in page.special:
            out[id(e)] = e.marked or bool(e.parent.special) and out[id(e.parent.special)]
        return out

    gone = covered()
    if not any(n and not (b.of.special and gone[id(b.of.special)]) for n, b in zip(size, live, strict=True)):
        left = [e for e in every if e.marked and net.get(id(e), 0) >= LONG]
        if left:
            e = max(left, key=lambda e: (id(e) in main, held[id(e)][1] > 0, net[id(e)]))
            while e:
                e.marked = False
                e = e.parent.special
            gone = covered()
    for b in live:
        if b.of.special and gone[id(b.of.special)]:
            b.drop = 2


def parsed(source: str) -> Page:
    """Blocks of text in page order, each with the container that holds it; never fails on broken markup.

    ``p`` and list or table cells end where the next one begins; an end tag
    without its start tag is ignored; what follows an unclosed comment or
    script is part of it. The work is in proportion to the page, however deep
    or broken its markup: every element is opened and closed once, and no step
    walks up the open ones beyond those that it closes.
    """
    page = Page()
    root = here = Element("body", 0, None, 0)
    root.within = root
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            page.blocks.append(Block(joined, here.within, here.heading, linked, here.drop, here))
        text.clear()
        linked = 0

    def up_to(stop: Element) -> None:
        """Close what is open in ``stop``, and ``stop``."""
        nonlocal here
        while True:
            if here.tag in BLOCKS:
                flush()
            open_[here.tag] -= 1
            last, here = here, here.parent
            if last is stop:
                return

    at = 0
    while m := TOKEN.search(source, at):
        if m.start() > at:
            text.append(source[at : m.start()])
            linked += (m.start() - at) if open_["a"] else 0
        at = m.end()
        if m[4]:
            at = end + 3 if (end := source.find("-->", at)) >= 0 else len(source)
            continue
        if not (tag := m[2] or m[6]):
            continue
        tag, rest = tag.lower(), m[3] or ""
        if m[1] or m[5]:
            if tag in BLOCKS:
                flush()
            if open_[tag]:
                e = here
                while e.tag != tag:
                    e = e.parent
                up_to(e)
            continue
        if tag == "br" or tag == "hr" and not flush():
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = END[tag].search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in BLOCKS:
            flush()
            if until := _to_close(tag, here):
                up_to(until)
        here = _element(tag, rest, here)
        open_[tag] += 1
        if tag in CONTAINERS:
            here.number = len(page.containers)
            page.containers.append(here)
        if here.special is here:
            page.special.append(here)
        if rest.endswith("/") and tag not in BLOCKS:
            open_[tag] -= 1
            here = here.parent
    if at < len(source):
        text.append(source[at:])
    if here is not root:
        while here.parent is not root:
            if here.tag in BLOCKS:
                flush()
            here = here.parent
        if here.tag in BLOCKS:
            flush()
        here = root
    flush()
    _marks(page)
    return page


def is_article(b: Block) -> bool:
    """Whether a block may belong to the article as far as its own surroundings tell."""
    return b.drop == 0 or b.drop == 1 and b.heading != ""


def scores(page: Page) -> dict[int, float]:
    """How well each container path alone gives the page's text, 0 to a little over 1.

    The harmonic mean of two shares: of the page's article-like text that the
    path holds, and of all text it would give that is article-like. Headings
    and long blocks count in full, shorter ones by their length, text that is
    mostly links not at all. A path without the page's main heading loses 0.2;
    article and main elements that hold half of the text gain 0.5 and 0.3; of
    equals, the deeper path wins.
    """
    long = min(LONG, max([len(b.text) for b in page.blocks if is_article(b) and not b.heading], default=1))
    # For each container, the root last: text that counts, all text, main headings.
    held = [[0.0, 0, 0] for _ in range(len(page.containers) + 1)]
    total = titles = 0
    for b in page.blocks:
        if is_article(b):
            n, at = len(b.text), held[b.within.number]
            fine = n if b.heading else n * min(n, long) / long if 2 * b.linked < n else 0
            title = b.heading == "h1"
            at[0], at[1], at[2] = at[0] + fine, at[1] + n, at[2] + (title and fine > 0)
            total, titles = total + fine, titles + title
    for e in reversed(page.containers):
        own, above = held[e.number], held[e.parent.within.number]
        above[0], above[1], above[2] = above[0] + own[0], above[1] + own[1], above[2] + own[2]
    found: dict[int, list] = {0: [*held[-1], "body", 0]}
    for e in page.containers:
        own, at = held[e.number], found.setdefault(e.path, [0.0, 0, 0, e.tag, e.level])
        at[0], at[1], at[2] = at[0] + own[0], at[1] + own[1], at[2] + own[2]
    out = {}
    for path, (good, every, heads, tag, level) in found.items():
        if good:
            recall, precision = good / total, good / every
            out[path] = 2 * recall * precision / (recall + precision) - 0.2 * (titles > 0 and not heads) + (recall >= 0.5) * {"article": 0.5, "main": 0.3}.get(tag, 0) + 0.001 * level
    return out


def best_of(own: dict[int, float]) -> int:
    """The path with the highest score; of equals, the one with the greatest key."""
    return max(own, key=lambda p: (own[p], p))


def extracted(page: Page, paths: list[int], backed: int = 0) -> str:
    """The article's blocks, joined by two line ends, from the first of ``paths`` that gives any.

    The first ``backed`` paths are the best of several pages each; those of
    them that are close to the page's own best go before all, so a page of a
    rarer template does not end with a small box that has the usual path.
    Without a path, the page's own best container is taken; an empty page
    gives the empty text.
    """
    own = scores(page)
    best = [best_of(own)] if own else []
    close = [p for p in paths[:backed] if p in own and own[p] >= own[best[0]] - CLOSE]
    for path in (close + [p for p in paths if p in own] + best)[:1]:
        inside = [path == 0] * (len(page.containers) + 1)
        for e in page.containers:
            inside[e.number] = e.path == path or inside[e.parent.within.number]
        return "\n\n".join(b.text for b in page.blocks if is_article(b) and inside[b.within.number])
    return ""


def host_of(url: str) -> F.Column:
    """The lower-case host of a URL column without port, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def signed(path: int) -> int:
    """A path's key as a long."""
    return path - (1 << 64) if path >> 63 else path


def votes(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """Votes for container paths on each host: ``host``, ``path``, ``pages``, ``score``. Each page votes for its best path, with its score."""
    rows = pages.select(host_of(url).alias("host"), F.col(markup).cast("string").alias("html")).where("html is not null and host <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, int], list[float]] = {}
            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if own := scores(parsed(source.as_py())):
                    path = best_of(own)
                    t = total.setdefault((host, path), [0.0, 0])
                    t[0] += round(own[path], 6)
                    t[1] += 1
            if total:
                yield pa.RecordBatch.from_pylist([{"host": h, "path": signed(p), "score": s, "pages": n} for (h, p), (s, n) in total.items()])

    return rows.mapInArrow(run, "host string, path long, score double, pages long").groupBy("host", "path").agg(F.round(F.sum("score"), 4).alias("score"), F.sum("pages").alias("pages"))


def winners(voted: DataFrame, paths: int = PATHS) -> DataFrame:
    """The best paths of each host, best first: ``host``, ``paths``, and how many of them several pages voted for: ``backed``."""
    # Votes, rounded scores, then the path make the order the same on every run.
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("score"), F.desc("path")))
    few = voted.withColumn("place", place).where(F.col("place") <= paths)
    ranked = few.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("all"), F.count_if(F.col("pages") > 1).alias("backed"))
    return ranked.select("host", F.transform("all", lambda x: x["path"]).alias("paths"), "backed")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text``, ``n_chars``.

    Null markup gives the empty text; a page without a host uses its own best
    container; repeated rows and null ids give a row each; other columns are
    ignored; an empty table gives no rows.
    """
    best = saved(winners(votes(pages, url, markup)), "paths")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html")).withColumn("host", host_of("url"))
    if (best.agg(F.sum(F.length("host") + 8 * F.size("paths") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(best), "host", "left")
    else:
        joined = lookup_join(rows, best, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extracted(parsed(s.as_py() or ""), [x & (1 << 64) - 1 for x in p or []], n or 0) for s, p, n in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "paths", "backed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
