"""WARC bundles and HTML extraction."""

import base64
import hashlib
import io
import random
import struct
import time

import pytest
import zstandard

from tentpole.llm import html_extract, warc

PAGES = [
    (0, "http://a.example/1", "<p>same</p>", "x"), (1, None, None, None), (2, "http://b.example/\r\nevil", "<p>same</p>", "x"), (3, "http://c.example", "", "y"),
    (4, "http://d.example", "ünï  " * 60_000, "y"), (5, "http://e.example", "<p>same</p>", "x"), (5, "http://e.example", "<p>same</p>", "x"), (None, "http://f.example", "<p>same</p>", "z"), (None, None, "alone", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(2)


def test_round_trip(pages):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    expected = []
    for i, _, text, _ in PAGES:
        data = (text or "").encode()
        same = [p for p, _, t, _ in PAGES if (t or "") == (text or "") and p is not None]
        again = sum((t or "") == (text or "") for _, _, t, _ in PAGES) > 1
        revisit = again and bool(same) and i != min(same)
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(expected, key=str)


def test_files_are_plain_zstandard_with_a_seek_table(pages, spark, tmp_path):
    warc.write(pages, tmp_path.as_uri() + "/w", frame_bytes=1000, bundle_bytes=3000)
    seen = 0
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        if not data:
            continue
        assert struct.unpack("<I", data[-4:])[0] == warc.FOOTER_MAGIC
        table = warc.seek_table(data)
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(plain) == sum(n for _, _, n in table)
        assert sum(n for _, n, _ in table) + 8 + 8 * len(table) + 9 == len(data)
        for _, k, at, n in warc.record_index(data):
            assert warc.frame(data, table, k)[at : at + n].startswith(b"WARC/1.1\r\n")
            seen += 1
    assert seen == len(PAGES)
    payload = {r.page_id: r.payload for r in warc.fetch(spark, tmp_path.as_uri() + "/w", spark.createDataFrame([(4,), (0,), (99,)], "page_id long")).collect()}
    assert {k: bytes(v) for k, v in payload.items()} == {4: PAGES[4][2].encode(), 0: b"<p>same</p>"}
    where = warc.index(spark, tmp_path.as_uri() + "/w")
    assert where.count() == len(PAGES)


def test_small_payloads_may_stay_responses(pages):
    with_limit = warc.with_revisits(pages, least_bytes=100).collect()
    assert all(r.first is None for r in with_limit)


def test_damage_is_noticed():
    b = warc.Bundle()
    b.add(1, warc.record(1, "u", b"x", "D", None, False, "d"))
    data = b.done()
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1] + b"\0")


def test_no_pages_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none).count() == 0
    assert html_extract.main_text(none).count() == 0


ARTICLE = "<h1>Title &amp; more</h1><p>First  paragraph\n with <b>bold</b>, long enough to be taken for prose by any measure of it.</p><p>Second one &eacute;&#233;, also long enough, with a <a href=x>link</a> inside of it.</p>"
TEXT = "Title & more\n\nFirst paragraph with bold, long enough to be taken for prose by any measure of it.\n\nSecond one éé, also long enough, with a link inside of it."
SHELLS = [
    "<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article>{}</article><footer>&copy; us</footer></body></html>",
    "<body><header class=site><h1>Our site</h1></header><div id='cookie-notice'>We use cookies here.</div><div class='wrap'><div class='post-12'>{}<div class='comments'><p>Great post, I really liked it a lot.</p></div></div><aside><p>Side</p></aside></div></body>",
    "<body><script>var t = '</p><article>no';</script><!-- <article>none</article> --><main>{}<form><p>Subscribe</p></form></main><div class='related'><p>Other things to read</p></div>",
    "<body><div class=sidebar>Links</div><section class='content'>{}</section><div role=contentinfo>Imprint</div><noscript>Turn it on</noscript>",
]


@pytest.mark.parametrize("shell", SHELLS)
def test_article_without_its_surroundings(shell):
    page = html_extract.parsed(shell.format(ARTICLE))
    assert html_extract.extracted(page, []) == TEXT


def test_host_consensus_helps_a_page_that_alone_would_fail(spark):
    good = [(k, "http://h.example/%d" % k, SHELLS[1].format(ARTICLE).replace("First", f"First{k}")) for k in range(6)]
    odd = (9, "http://h.example/9", "<body><div class='wrap'><div class='post-9'><p>Short.</p></div><div class='zone'><p>" + "A long text that is about something else. " * 20 + "</p></div></div></body>")
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame([*good, odd], "page_id long, url string, html string")).collect()}
    assert got[9].text == "Short."
    assert got[3].text == TEXT.replace("First", "First3") and got[3].n_chars == len(got[3].text)


def test_odd_pages(spark):
    table = [(1, None, None), (2, "nonsense", ""), (3, "http://x.example", "just text & no tags"), (4, "http://x.example", "<p>open <b>never <i>closed"), (5, None, "<div"), (6, None, "<!-- open"), (None, None, "<p>a<br>b</p>"), (7, None, "<p>&bogus; &lt;tag&gt; &#x41;</p>"), (7, None, "<p>&bogus; &lt;tag&gt; &#x41;</p>"), (8, None, "<p>" * 3000 + "deep")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(table, "page_id long, url string, html string")).collect()]
    text = dict((p, t) for p, t, _ in got)
    assert len(got) == len(table) and all(n == len(t) for _, t, n in got)
    assert text[1] == text[2] == text[5] == text[6] == ""
    assert (text[3], text[4], text[None], text[7], text[8]) == ("just text & no tags", "open never closed", "a b", "&bogus; <tag> A", "deep")


@pytest.mark.parametrize("shell", [
    "<body><div class='layout has-sidebar'><article>{}</article></div></body>",
    "<body><div class='content with-comments'>{}<div class='comments'><p>Great post, I really liked it a lot.</p></div></div></body>",
    "<body><div class='post related-post'>{}</div><div class='related'><p>Other things to read</p></div></body>",
    "<body><div class='page-wrap ad-free'><div class='sidebar'>Links</div><div class='layout has-sidebar'>{}</div></div></body>",
    "<body><form id=aspnetForm><div id=main><article>{}</article></div></form></body>",
    "<body><form><input name=q><label>Search our shop</label><div class=text>{}</div><form class=newsletter><p>Write to us</p></form></form></body>",
    "<body><div role=banner>Our site</div><div role=dialog><main>{}</main></div><div role=contentinfo>Imprint</div></body>",
    "<body><main role=form>{}</main><header role=banner><h1>Site</h1></header><dialog><p>We use cookies</p></dialog></body>",
    "<body><dialog open><div>{}<form><p>Leave a comment here</p></form></div></dialog></body>",
])
def test_a_wrapper_named_like_boilerplate_keeps_its_article(shell):
    assert html_extract.extracted(html_extract.parsed(shell.format(ARTICLE)), []) == TEXT


def test_a_rarer_template_with_the_usual_path_on_a_small_box(spark):
    usual = [(k, "http://h.example/%d" % k, f"<body><div><h1>Title {k}</h1><p>" + f"Usual text number {k} of some length. " * 9 + "</p></div></body>") for k in range(6)]
    rare = [(10 + k, "http://h.example/r%d" % k, f"<body><div><p>Small box.</p></div><section class=text><h1>Rare {k}</h1><p>" + f"Rare text number {k} of some length. " * 9 + "</p></section></body>") for k in range(2)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame([*usual, *rare], "page_id long, url string, html string")).collect()}
    assert all(got[10 + k].startswith(f"Rare {k}\n\nRare text") for k in range(2))
    assert all(got[k].startswith(f"Title {k}\n\nUsual text") for k in range(6))


def generated_pages(n: int) -> list[tuple]:
    """Pages of a few hosts in templates of their own, with broken and nested markup, and some without a host."""
    rng, out = random.Random(4), []
    words = "some text that goes on for a while about nothing at all".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
    inner = [lambda: f"<p>{text()}</p>", lambda: f"<h1>{text()}</h1>", lambda: f"<ul><li>{text()}<li><a href=x>{text()}</a></ul>", lambda: f"<b>{text()}", lambda: f"<section class='c{rng.randrange(3)}'>{text()}", lambda: f"<table><tr><td>{text()}<td>{text()}</table>", lambda: "</div></i>"]
    for k in range(n):
        host = rng.randrange(5)
        boxes = [f"<div class='box{host}'>", "<article>", "<div id=sidebar>", "<main>", "<div>", "<header>", "<div class='post related-post'>"]
        body = "".join(rng.choice(boxes) + "".join(rng.choice(inner)() for _ in range(rng.randrange(5))) + rng.choice(["</div>", "</article>", ""]) for _ in range(rng.randrange(1, 5)))
        out.append((k, f"http://h{host}.example/{k}" if host else None, body))
    return out


def plain_scores(page: html_extract.Page) -> dict[int, float]:
    """The scores of all container paths, each from the blocks that have it above them."""
    live = [b for b in page.blocks if html_extract.is_article(b)]
    long = min(html_extract.LONG, max([len(b.text) for b in live if not b.heading], default=1))
    fine = [len(b.text) if b.heading else len(b.text) * min(len(b.text), long) / long if 2 * b.linked < len(b.text) else 0 for b in live]

    def above(b):
        e, paths = b.within, {}
        while e:
            if e.tag in html_extract.CONTAINERS:
                paths[e.path] = e
            e = e.parent
        return paths

    out = {}
    for path, e in {p: e for b in live for p, e in above(b).items()}.items():
        own = [k for k, b in enumerate(live) if path in above(b)]
        if good := sum(fine[k] for k in own):
            recall, precision = good / sum(fine), good / sum(len(live[k].text) for k in own)
            lost = any(b.heading == "h1" for b in live) and not any(live[k].heading == "h1" for k in own)
            out[path] = 2 * recall * precision / (recall + precision) - 0.2 * lost + (recall >= 0.5) * {"article": 0.5, "main": 0.3}.get(e.tag, 0) + 0.001 * e.level
    return out


def test_votes_and_texts_equal_a_plain_version(spark):
    table = generated_pages(300)
    hosts, pages = {}, {}
    for k, url, body in table:
        page = pages[k] = html_extract.parsed(body)
        own, plain = html_extract.scores(page), plain_scores(page)
        assert own.keys() == plain.keys() and all(abs(own[p] - plain[p]) < 1e-9 for p in own)
        if own and url:
            best = max(own, key=lambda p: (own[p], p))
            t = hosts.setdefault(url.split("/")[2], {}).setdefault(best, [0, 0.0])
            t[0], t[1] = t[0] + 1, t[1] + round(own[best], 6)
    ranked = {h: sorted(v, key=lambda p: (v[p][0], round(v[p][1], 4), html_extract.signed(p)), reverse=True)[: html_extract.PATHS] for h, v in hosts.items()}
    expected = {}
    for k, url, _ in table:
        host = url.split("/")[2] if url else None
        own = plain_scores(pages[k])
        paths = ranked.get(host, [])
        backed = [p for p in paths if hosts[host][p][0] > 1]
        top = max(own, key=lambda p: (own[p], p)) if own else None
        order = [p for p in backed if p in own and own[p] >= own[top] - html_extract.CLOSE] + [p for p in paths if p in own] + ([top] if own else [])
        lines = []
        for b in pages[k].blocks if order else []:
            e = b.within
            while e and e.path != order[0]:
                e = e.parent
            if e and html_extract.is_article(b):
                lines.append(b.text)
        expected[k] = "\n\n".join(lines)
    clashing = spark.createDataFrame([(*r, "x", "y") for r in table], "page_id long, url string, html string, host string, paths string").repartition(3)
    assert {r.page_id: r.text for r in html_extract.main_text(clashing).collect()} == expected
    assert sum(len(t) > 0 for t in expected.values()) > 200


@pytest.mark.parametrize("markup", ["<div>x" * 50_000, "<b>" * 25_000 + "</i>x" * 25_000, "<b><p>x" * 25_000, "<b>" * 25_000 + "<p>y</p>" * 25_000, "<div class=nav>x" * 50_000, "<header>x" * 50_000, "<article><div class=ad>x" * 25_000, "<table><tr><td>x" * 16_000, "<div " + "a" * 400_000 + ">x", "<script>" + "</script <x " * 40_000, "<a \"'" * 50_000])
def test_deep_and_broken_markup_takes_time_in_proportion(markup):
    begin = time.process_time()
    html_extract.extracted(html_extract.parsed(markup), [])
    assert time.process_time() - begin < 6
