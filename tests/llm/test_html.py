import os
import re
import time
from html.parser import HTMLParser

import pytest

from featspan.llm.html import extract, main_text

BODY = " ".join(f"Sentence number {i} of the article, long enough to weigh." for i in range(12))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one<p>two <b>bo<i>ld</b>", "one two bold"),
        ("<p>a<br>b\n\tc&nbsp;d</p>", "a b c d"),
        ("<p>&lt;p&gt; &amp;lt; &#233;&eacute;</p>", "<p> &lt; éé"),
        ("<title>t</title><style>p{}</style><script>'</p>'</script><p>x</p>", "x"),
        ("<p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
        ("<p title='a>b'>x</p>", "x"),
        ("<ul><li>one<li>two</ul>", "one two"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def page(article, **parts):
    return (
        "<!DOCTYPE html><html><head><title>T</title></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies for this and that, please agree.</div>"
        f"{parts.get('before', '')}{article}{parts.get('after', '')}"
        "<aside>Also read this other piece of ours.</aside><form><label>Mail</label><input></form>"
        "<section id='comments'><p>First! I liked it a lot, thank you.</p></section><footer>&copy; us</footer></body></html>"
    )


def test_the_article_alone():
    assert main_text(page(f"<article><h1>Head</h1><p>{BODY}</p><div class='ad'>Buy</div></article>")) == f"Head {BODY}"


def test_a_short_article_beside_a_long_list():
    teasers = "".join(f"<div class='teaser'><p>{BODY}</p></div>" for _ in range(5))
    assert main_text(page("<article><h1>Head</h1><p>Short.</p></article>", after=teasers)) == "Head Short."
    assert main_text(page(f"<main><div class='header'>H</div><p>{BODY}</p><div id='commentlist'>no</div></main>")) == f"H {BODY}"


def test_density_finds_an_unnamed_article():
    paragraphs = "".join(f"<p>{BODY} <a href=/x>link</a></p>" for _ in range(4))
    links = "<div>" + "".join(f"<a href=/{i}>topic {i}</a> " for i in range(60)) + "</div>"
    text = main_text(page(f"<div class='story'><h2>Head</h2>{paragraphs}</div>", after=links))
    assert text == "Head " + " ".join([f"{BODY} link"] * 4)


def test_sections_of_one_article_stay_together():
    section = f"<div class='part'><p>{BODY}</p><p>{BODY}</p></div>"
    assert main_text(page(f"<div class='story'>{section * 3}</div>")).count(BODY) == 6


def test_names_drop_whole_boxes_only():
    kept = (
        f'<p title="Hidden gems of Rome">{BODY}</p><div data-id="share"><p>shared</p></div><h2 id="related">Related</h2>'
        '<section id="related-work"><p>work</p></section><section id="social-impact"><p>impact</p></section>'
        '<div id="share-price"><p>price</p></div><div id="notice-period"><p>period</p></div><div class="commentary"><p>said</p></div>'
    )
    gone = "<div class='share-buttons'>x</div><div id=comments-2>x</div><p hidden>x</p><div class='a ad'>x</div><div style='display: none'>x</div>"
    want = f"{BODY} shared Related work impact price period said"
    assert main_text(page(f"<article>{kept}{gone}</article>")) == want
    assert main_text(page(f"<div class='story'>{kept}{gone}</div>")) == want


def paragraphs(n, size=600):
    return "".join(f"<p>{('word%d ' % i) * (size // 6)}</p>" for i in range(n))


@pytest.mark.parametrize(("sections", "each"), [(2, 7), (2, 10), (3, 12), (3, 20)])
def test_long_sections_without_marks_stay_together(sections, each):
    links = "<div>" + "".join(f"<a href=/{i}>topic {i}</a> " for i in range(60)) + "</div>"
    part = f"<div class='part'><h3>Part</h3>{paragraphs(each)}</div>"
    text = main_text(page(f"<div class='story'><h2>Head</h2>{part * sections}</div>", after=links))
    assert text.startswith("Head Part word0") and text.count("word") == sections * each * 100 and "topic" not in text
    # also where the sections stand in the body itself, of unlike lengths
    text = main_text(f"<body>{links}{part}{links}<div>{paragraphs(each, 450)}</div>{links}</body>")
    assert text.count("word") == each * 175 and "topic" not in text


def test_marks_do_not_decide_alone():
    text = paragraphs(8)
    small = "<article><h3>Other</h3><p>A small teaser.</p></article>"
    for story in (f"<div>{text}</div>", f"<div>{re.sub('</?p>', ' ', text)}</div>", f"<div><div>{text}</div></div>"):
        assert main_text(page(story, after=small)) == main_text(text)
    parts = "".join(f"<article><h2>Part {k}</h2>{text}</article>" for k in range(3))
    assert main_text(page(parts)).count("word") == 3 * 800
    inner = f"<h1>Title</h1><div><section>{paragraphs(20)}</section><section>{paragraphs(20)}</section></div>"
    for tag in ("article", "main"):
        got = main_text(page(f"<{tag}>{inner}</{tag}>"))
        assert got.startswith("Title word0") and got.count("word") == 4000


def test_hostile_markup_ends_soon():
    started = time.perf_counter()
    for html in ("<div>" * 20_000 + "x", "<" * 50_000, "<a " + 'b="' * 20_000, "<p " * 20_000, "<!--" * 20_000, "</p>" * 20_000):
        assert isinstance(main_text(html), str)
    assert time.perf_counter() - started < 60


def test_every_row_comes_back(spark):
    rows = [(1, None, None, "c"), (1, None, None, "c"), (None, "u", "<p>a</p>", "c"), (3, "v", "<p>é" + "x" * 100_000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text[:2], r.n_chars) for r in extract(df).collect()), key=str)
    assert got == [(0, "u", "a", 1), (1, None, "", 0), (1, None, "", 0), (3, "v", "éx", 100_001)]
    assert extract(df.limit(0)).count() == 0


LINES = "This is a longer paragraph of the article with many words, so that it counts as text. " * 3


def test_quotes_where_they_do_not_belong():
    assert main_text(f"<body><article><p data-x=5'10>He's tall {LINES}</p><p>It's more</p></article>").startswith("He's tall This")
    assert main_text(f'<body><article><p class="a"">one {LINES}</p><p>two</p></article>').startswith("one This")
    assert main_text(f"<body><article><p title='a\"b' = x='>'>one {LINES}</p></article>").startswith("one This")


def test_a_name_alone_does_not_drop_prose():
    page = f'<body><article><p>{LINES}</p><section id="social"><p>kept {LINES}</p><p>{LINES}</p></section><div class="share"><a href=x>Share</a><p>Tell all</p></div>'
    page += '<div class="comments">' + f"<p>said {LINES}</p>" * 9 + "</div></article></body>"
    text = main_text(page)
    assert "kept" in text and "Tell all" not in text and "said" not in text


def test_a_page_inside_one_form():
    assert main_text(f"<body><form action=x><h1>Title</h1><p>{LINES}</p><p>{LINES}</p><input></form></body>").startswith("Title This")
    assert "Login" not in main_text(f"<body><div><p>{LINES}</p><p>{LINES}</p></div><form><p>Login here</p></form></body>")


def test_deep_nesting_takes_linear_time():
    import time

    def seconds(n):
        started = time.perf_counter()
        main_text("<div>" * n + "<li>x</b></p>" * n)
        return time.perf_counter() - started

    seconds(1000)
    assert seconds(64_000) < 12 * max(seconds(16_000), 0.05)


class Plain(HTMLParser):
    """The text of the given pages by their fixed form: all of the one article, blocks apart."""

    BLOCKS = frozenset("article h1 p br div ul li".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_given_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) == 250
    for r in rows:
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        text = " ".join("".join(plain.parts).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)
