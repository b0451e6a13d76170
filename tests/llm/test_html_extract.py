import html as htmllib
import re
import tracemalloc

import pytest

from tagloom.llm import html_extract as h
from tests.llm.helpers import with_clashes


def brute(page):
    body = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body.group(1)) if body else []
    plain = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(b for b in plain if b)


def test_given_pages_equal_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = h.extract_pages(with_clashes(pages)).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == brute(source[r.page_id].html) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


@pytest.mark.parametrize("page, expected", [
    ("", ""), ("<p>", ""), ("just text", "just text"), ("<nav>a</nav><p>b &amp; c&nbsp;d</p>", "b & c d"), ("<div class='content'><p>one<p>two</div><footer>x</footer>", "one\ntwo"),
    ("<div id=comments><p>no</p></div><article><h2>T</h2>a<br>b</article>", "T\na b"), ("<article><p>a<script>var x='</p>'</script>b</p>", "ab"),
    ("<article><ul><li>1<li>2</ul><div class='ad-box'>buy</div><p>x</p></article>", "1\n2\nx"), ("<article><p>cut off <b>here", "cut off here"), ("<article><!-- <p>no</p> --><p>a</p></article>", "a"),
    ("<article><p>a < b and 1<2</p></article>", "a < b and 1<2"), ("<ARTICLE><P CLASS=x>Up</P></ARTICLE>", "Up"), ("<article><div hidden>no</div><p title='a>b'>yes</p></article>", "yes"),
])
def test_small_pages(page, expected):
    assert h.extract(page, None) == expected


_INTRO = "<h1>A title of the page</h1><p>" + "Some words that lead in. " * 8 + "</p>"
_PARTS = {
    "list": "<ul>" + "<li>An item of the list with some words in it.</li>" * 60 + "</ul>",
    "table": "<table><tr><th>Name of it</th></tr>" + "<tr><td>A cell with some words in it.</td></tr>" * 40 + "</table>",
    "cells": "<table><tbody>" + "<tr><td><div>A cell with some words in it.</div></td></tr>" * 40 + "</tbody></table>",
    "terms": "<dl>" + "<dt>Term</dt><dd><p>What it means in some more words.</p></dd>" * 40 + "</dl>",
    "sections": "<section><h2>Part</h2><p>Words of a part that go on for a while.</p></section>" * 40,
    "body": "<div class='body'>" + "<p>Words of the body that go on for a while.</p>" * 40 + "</div>",
}


@pytest.mark.parametrize("holder, kinds", [("article", list(_PARTS)), ("main", ["list", "table", "cells", "terms", "sections"]), ("div", ["list", "table", "terms"])])
def test_parts_that_outweigh_the_prose(holder, kinds):
    for kind in kinds:
        page = f"<body><nav>Home</nav><{holder} class=x>{_INTRO}{_PARTS[kind]}<p>The end.</p></{holder}><div class=other><p>Something else.</p></div></body>"
        inner = re.sub(r"<[^>]*>", " ", _INTRO + _PARTS[kind] + "<p>The end.</p>")
        assert h.extract(page, None).split() == inner.split(), (holder, kind)


def test_parts_do_not_win_a_host(spark):
    heavy = f"<article>{_INTRO}{_PARTS['list'] * 2}</article>"
    plain = "<article><p>Prose of another page of the host.</p><ul><li>one</li></ul></article>"
    df = spark.createDataFrame([(i, "http://a.b/x", heavy) for i in range(50)] + [(99, "http://a.b/y", plain)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract_pages(df).collect()}
    assert got[0].startswith("A title of the page") and got[99] == "Prose of another page of the host.\none"


def test_hosts_outvote_a_page(spark):
    story = "".join(f"<p>Paragraph {i} of a story that goes on for a while.</p>" for i in range(8))
    usual = f"<body><div class='story-12'>{story}</div><div class='extra'><p>Read also this</p></div></body>"
    odd = "<body><div class='story-77'><p>Short story.</p></div><div class='extra'>" + "<p>Read also this and that and much more of it.</p>" * 20 + "</div></body>"
    rows = [(i, "https://www.Example.org:80/a", usual) for i in range(5)] + [(9, "http://example.org/b", odd), (10, None, None), (11, "no url", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract_pages(df).collect()}
    assert got[9] == "Short story." and "Read also" not in got[0] and got[10] == "" and got[11] == "x"
    assert h.extract_pages(df.limit(0)).collect() == []
    assert h.extract_pages(df.union(df)).count() == 16


@pytest.mark.parametrize("inside", [
    "<svg/>", '<svg width="1" />', "<datalist><option>a<option>b</datalist>", "<canvas>", "<script>x</script foo>", "<svg><svg><text>no</text></svg><text>no</text></svg>", "<svg><path d='1'>", "<noscript><img>no</noscript>",
    "<select><option>no<option>no</select>", "<iframe src=x></iframe>", "<object><object>no</object>no</object>", "<video>", "<style>p{}</style >", "<textarea>no</textarea>", "<math><mi>no</mi></math>", "<template><p>no</p></template>",
])
def test_embedded_markup_loses_no_text(inside):
    assert h.extract(f"<article><p>Before it.</p>{inside}<p>After it.</p></article>", None) == "Before it.\nAfter it."


@pytest.mark.parametrize("name", ["class='related-work'", "class='side-effects'", "class='share-price'", "id='search-algorithms'", "class='cookie-recipes'", "id=navigation-by-stars", "class='content-sidebar-wrap'", "class='with-sidebar'"])
def test_names_alone_do_not_drop_sections(name):
    page = f"<article><p>Before it.</p><section {name}><h2>Part</h2><p>Prose of a part, with <a href=x>one</a> link among many words.</p></section></article>"
    assert h.extract(page, None) == "Before it.\nPart\nProse of a part, with one link among many words."


@pytest.mark.parametrize("name", ["class='ad'", "class='site-footer'", "class='relatedPosts'", "id='comments'", "class=comment-content", "class='x cookie-consent'", "class='acme-sidebar'", "class='my-related-stuff'"])
def test_boilerplate_within_articles(name):
    links = " ".join(f"<a href={i}>Another page</a>" for i in range(5))
    assert h.extract(f"<article><p>Before it.</p><div {name}><p>{links}</p></div><p>After it.</p></article>", None) == "Before it.\nAfter it."


def test_deep_nesting_is_linear():
    deep = "".join(f"<div class=c{i}>t{i} " for i in range(50_000))
    tracemalloc.start()
    page = h.Page(deep)
    scores = page.scores()
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and len(page.blocks) == 50_000 and len(scores) > 10_000
    tracemalloc.stop()
    assert h.extract("<b>" * 20_000 + "<div>x</div>" * 20_000 + "</i>" * 20_000, None).count("x") == 20_000


def test_long_page_is_linear():
    text = h.extract("<article>" + "<p>word</p>" * 50_000, None)
    assert text == "\n".join(["word"] * 50_000)
    assert h.extract("<div>" * 3000 + "deep", None) == "deep"


_ART = "<h1>A title</h1><p>" + "Some words of the article itself. " * 20 + "</p><p>And its end.</p>"
_ART_TEXT = re.sub(r"<[^>]*>", " ", _ART).split()
_REST = "<nav><a href=/>Home</a></nav>{}<footer>About us</footer>"


@pytest.mark.parametrize("page", [
    f"<div style='overflow:hidden'>{_ART}</div>", f"<div class=right-sidebar>{_ART}</div>", f"<div class='sidebar-left'><main>{_ART}</main></div>", f"<div class=promo-article>{_ART}</div>",
    f"<div class=search-page><div class=content>{_ART}</div></div>", f"<form action=/x method=post><input type=hidden name=state><div id=content>{_ART}</div><select><option>1</select></form>",
    f"<div title='a hidden gem'>{_ART}</div>", f"<div data-hidden>{_ART}</div>", f"<div data-role=navigation>{_ART}</div>", f"<div data-class='ad'>{_ART}</div>",
    f"<article>{_ART.replace('<h1>', '<h1 class=page-header>').replace('<p>', '<p class=related>')}</article>", f"<div class=layout-sidebar><article>{_ART}</article></div>",
    f"<div style='color:red;display:none'>{_ART}</div>", f"<div class=sidebar><form><div class=promo>{_ART}</div></form></div>",
])
def test_wrappers_named_like_boilerplate_stay(page):
    for whole in (page, _REST.format(page), _REST.format(page + "<div class=ads>Buy this now</div>")):
        assert h.extract(whole, None).split() == _ART_TEXT, whole[:120]


def test_a_link_of_any_address_stays():
    assert h.extract("<article><p>see <a href='/hidden/x'>the page</a> there</p></article>", None) == "see the page there"


@pytest.mark.parametrize("other", [
    "<div class=reader-reactions>{}</div>", "<div id=comments><article class=comment-body>{}</article></div>", "<div class=related-posts><article>{}</article></div>", "<form class=login>{}</form>",
    "<div class=sidebar><article>{}</article></div>", "<div class=sidebar>{}</div>", "<div style='display: none'>{}</div>", "<p class=advert>{}</p>", "<span class=ad>{}</span>",
])
def test_what_is_beside_the_article_goes(other):
    for tag, n in (("article", 1), ("div class=post-body", 1)):
        page = f"<{tag}>{_ART}</{tag.split()[0]}>" + other.format("<b>Words of somebody else.</b> " * 20 * n)
        assert h.extract(page, None).split() == _ART_TEXT, page[:100]
    short = "<div class=post-body><p>" + "A short article of few words. " * 10 + "</p></div>"
    assert "somebody" not in h.extract(short + "<div class=reader-reactions>" + "<p>Words of somebody else.</p>" * 60 + "</div>", None)


def test_attributes():
    assert h.attributes(" class=a  ID='b c' hidden data-x=\"hidden\" style = \"x:'y'\" class=z /") == {"class": "a", "id": "b c", "hidden": "", "data-x": "hidden", "style": "x:'y'"}
