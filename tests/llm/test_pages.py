"""Main text of pages, and archives there and back."""

import base64
import collections
import hashlib
import io

import pytest

from tsquant.llm import warc
from tsquant.llm.html_text import extract_text, main_text, smooth
from tsquant.llm.scratch import Scratch

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="nav-open">
<header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article><h1>A &amp; B</h1><p>First   <b>bold</b>
line<br>more<p>Second &eacute;&#x41;<ul><li>i<li>ii</ul>
<div class="ad">Buy</div><form>mail <input></form><p>Short.</article>
<aside>Side</aside><section id="comments"><article><p>I like this comment a lot, it is a long one.</p></article></section>
<footer>&copy; x</footer></body></html>"""


def test_article_without_what_stands_beside():
    assert main_text(PAGE) == "A & B\nFirst bold line more\nSecond éA\ni\nii\nShort."


def test_pages_without_an_article_keep_the_dense_stretch():
    body = "".join(f"<p>Paragraph {i} has a good number of words in it.</p>" for i in range(5))
    html = f"<body><div id=menu><a>a</a></div><div><a>x</a> <a>y</a></div><div class=content>{body}</div></body>"
    assert main_text(html).split("\n") == [f"Paragraph {i} has a good number of words in it." for i in range(5)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b</p>", "a\nb"),
        ("<div class=ad><p>x</div", ""),
        ("<nav>menu<article><p>left open</article>", "left open"),
        ("<article><p>un<i>closed<b>tags", "unclosedtags"),
        ("<article>a<script>b</article>", "a"),
        ("<article><!-- c --><p>&lt;p&gt; &amp;amp;</article>", "<p> &amp;"),
        ("</p></div><article>x</span></article></article>", "x"),
        ("<<<>>&&#0;&#xffffff;", "<<<>>&��"),
    ],
)
def test_odd_markup(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("name", ["page no-sidebar", "has-sidebar", "site-with-menu", "search-result"])
def test_names_that_only_mention_a_part(name):
    html = f"<body><div class='{name}'><p>The text of the page stands here.</p></div><div class='site-footer'>End</div></body>"
    assert main_text(html) == "The text of the page stands here."


@pytest.mark.parametrize("head", ["<header class='entry-header'>{}</header>", "<div class='article-header'>{}</div>"])
def test_headline_blocks_of_an_article(head):
    html = f"<article>{head.format('<h1>Headline</h1>')}<p>Text of it.</p><div class='ad-box'>Buy</div></article>"
    assert main_text(html) == "Headline\nText of it."


def test_smoothing_keeps_a_constant():
    assert smooth([3.0] * 7) == pytest.approx([3.0] * 7)
    assert smooth([5.0]) == pytest.approx([5.0])


BODY = "<h1>The title</h1>" + "".join(f"<p>Paragraph {i} " + "with a good many plain words " * 7 + "</p>" for i in range(4))
TEXT = "The title\n" + "\n".join((f"Paragraph {i} " + "with a good many plain words " * 7).strip() for i in range(4))
MENU = "<div class='nav'>" + " ".join(f"<a href='/{i}'>Link {i}</a>" for i in range(12)) + "</div>"
FOOT = "<div class='footer'><a href='/i'>Imprint</a> <a href='/c'>Contact</a></div>"
TALK = "<div class='comments'>" + "".join(f"<p>Reader {i} says " + "many words of an own " * 9 + "</p>" for i in range(20)) + "</div>"
COOKIES = "<div class='cookie-notice'><p>We use cookies to remember you, and you may refuse them at any time you like.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        MENU + BODY + FOOT,
        MENU + f"<div class='content'>{BODY}</div>" + FOOT,
        MENU + f"<form id='aspnetForm' action='/'>{BODY}<input name='q'></form>" + FOOT,
        MENU + f"<div class='related-layout'>{BODY}</div>" + FOOT,
        MENU + f"<div class='sidebar-left'>{BODY}</div>" + FOOT,
        MENU + f"<div id='main-nav-wrapper'>{BODY}</div>" + FOOT,
        f"<div class='page no-sidebar'>{MENU}<div id='main-nav-wrapper'><form>{BODY}</form></div>{FOOT}</div>",
        COOKIES + MENU + f"<div class='sidebar-left'>{BODY}{COOKIES}</div>" + FOOT,
        MENU + f"<div role='form'>{BODY}</div><form><p>Search this site for words</p><input></form>" + FOOT,
        "<header><p>A site of some name, with a line that says what it is about, at length</p></header>" + MENU + f"<table><tr><td>{BODY}</td></tr></table>" + FOOT,
        MENU + f"<div class='post'>{BODY}</div>{TALK}" + FOOT,
        MENU + f"<div class='post'>{BODY}</div><div class='related'><p>{'Read this other story too. ' * 4}</p><p>{'And this one. ' * 8}</p></div>" + FOOT,
        MENU + f"<article><div class='review-discussion'>{BODY}</div></article>" + FOOT,
        MENU + f"<article>{BODY}{TALK}</article>" + FOOT,
        MENU + f"<div class='sidebar-wrapper'><article>{BODY}<div class='ad'>Buy now</div></article></div>" + FOOT,
        f"<article>{BODY.replace('Paragraph 2', 'Paragraph <span class=ad>cheap </span>2')}</article>",
    ],
)
def test_names_are_overruled_by_dense_lines_and_by_them_alone(page):
    assert main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == TEXT


def test_pages_with_nothing_but_parts_beside():
    assert main_text(f"<html><body>{MENU}{FOOT}</body></html>") == ""
    assert main_text(f"<html><body>{MENU}{COOKIES}<article></article>{FOOT}</body></html>") == ""
    assert main_text(f"<html><body><article></article>{TALK}</body></html>") == ""


def test_rows_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "<p>x"), (4, "w", "<div>" * 20_000 + "deep")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS text", "1 AS k0")
    found = extract_text(frame).collect()
    assert sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in found)) == sorted(
        (i or 0, u or "", main_text(h or ""), len(main_text(h or ""))) for i, u, h in rows
    )
    assert extract_text(frame.limit(0)).collect() == []


def reference(rows):
    by = collections.defaultdict(list)
    for page, url, html in rows:
        by[html or ""].append((page, url))
    out = []
    for html, pages in by.items():
        first = max(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or ""))
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        # Of equal rows one is the response.
        pages.remove(first)
        out.append((first[0], len(html.encode()), digest, "response", None))
        out += [(page[0], len(html.encode()), digest, "revisit", first[0]) for page in pages]
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/x", ""), (2, None, None), (3, "u", "é\r\n\r\nWARC/1.1\r\nx\x00"), (4, "u", "é\r\n\r\nWARC/1.1\r\nx\x00"),
    (None, "u", "z"), (5, "u", "z"), (5, "u", "z"), (6, "u", "q"), (6, "v", "q"), (7, "https://h/p?q#f", "\U0001f600" * 10),
    (8, "u", "long " * 100_000),
]


def test_archives_there_and_back(spark):
    from pyspark.sql import functions as F

    scratch = Scratch(spark, "test-warc")
    frame = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS id")
    warc.write_warc(warc.captures(frame), scratch.path("w"), file_captures=2)
    records = warc.read_records(spark, scratch.path("w"))
    assert collections.Counter(r.kind for r in records.collect())["request"] == len(ROWS)
    found = warc.assemble(records).cache()
    rows = found.select(
        warc.field(F.col("metadata.text"), "page-id").cast("long"), "answer.payload_bytes", "answer.payload_digest", "answer.type",
        warc.field(F.col("metadata.text"), "refers-to-page").cast("long"),
    )
    assert sorted(map(tuple, rows.collect()), key=repr) == reference(ROWS)
    answers = [r.answer for r in found.collect()]
    payloads = {bytes(a.payload) for a in answers if a.type == "response"}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}
    assert all(a.intact for a in answers if a.type == "response")
    assert all(r.request.text.startswith("GET ") for r in found.collect())
    named = {r.capture_id for r in found.collect()}
    assert {a.refers_to for a in answers if a.type == "revisit"} <= named


def test_every_repeated_row_comes_back(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "other"), (1, "u", "same"), (None, None, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    decided = warc.captures(frame).collect()
    assert len(decided) == 6 == len({r.record_id for r in decided})
    scratch = Scratch(spark, "test-warc")
    warc.write_warc(warc.captures(frame), scratch.path("w"))
    found = warc.assemble(warc.read_records(spark, scratch.path("w"))).collect()
    assert collections.Counter(r.answer.type for r in found) == {"response": 3, "revisit": 3}


def test_archives_of_other_names_are_read_and_none_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"page {i}") for i in range(4)], "page_id long, url string, html string")
    warc.write_warc(warc.captures(frame).coalesce(1), str(tmp_path / "w"), file_captures=2)
    (tmp_path / "copy").mkdir()
    for at, file in enumerate(sorted((tmp_path / "w").glob("part-*"))):
        (tmp_path / "copy" / f"CC-{at}.warc.gz").write_bytes(file.read_bytes())
    assert warc.read_records(spark, str(tmp_path / "copy")).count() == 12
    assert warc.read_records(spark, str(tmp_path / "copy"), glob="CC-0*").count() == 6
    with pytest.raises(ValueError, match="no archive"):
        warc.read_records(spark, str(tmp_path / "copy"), glob="part-*")


def test_no_pages(spark):
    scratch = Scratch(spark, "test-warc")
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.captures(frame), scratch.path("w"))
    assert warc.assemble(warc.read_records(spark, scratch.path("w"))).collect() == []


def test_small_payloads_are_all_responses(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    found = {r.id: r.type for r in warc.captures(frame, least=3).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_orphans_and_repeats(spark):
    rows = [("request", "<r>", "<a>", "GET"), ("metadata", "<m>", "<b>", "x: 1"), ("metadata", "<m>", "<b>", "x: 1"), ("warcinfo", "<i>", None, "")]
    frame = spark.createDataFrame(rows, "kind string, id string, concurrent_to string, text string")
    for name, kind in (("url", "string"), ("date", "string"), ("refers_to", "string"), ("payload_digest", "string"),
                       ("payload_bytes", "long"), ("intact", "boolean"), ("payload", "binary")):
        frame = frame.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    found = {r.capture_id: (r.answer, r.request, r.metadata) for r in warc.assemble(frame).collect()}
    assert found == {"<a>": (None, ("<r>", "GET"), None), "<b>": (None, None, ("<m>", "x: 1"))}


def test_broken_archives_are_refused():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len([*warc.records_of(io.BytesIO(whole * 2))]) == 2
    for broken in (whole[:-5], b"x" + whole, whole[:-4] + b"\n\n\n\n"):
        with pytest.raises(ValueError):
            [*warc.records_of(io.BytesIO(broken))]
