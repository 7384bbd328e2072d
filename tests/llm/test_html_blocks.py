import time

import pytest

from webdiag.llm import html_blocks as hb

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="login-page">
<header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>Side text that is quite long and not wanted here at all.</p></div>
<article><header class="article-header"><h1>The &eacute;nd</h1></header><p>First  para<br>graph &lt;b&gt; <b>bold</b>ly.
<p>One.</p><script>var x="</p><p>no";</script><!-- <p>no --><div class="ad">Buy</div>
<p><a href="/x">A wholly linked line</a></p><form><label>Your name</label><input></form>
<div class="comments"><p>First! A reader comment of many words, longer than any other text on this page by far.</p></div>
</article><aside>Related</aside><footer>&copy; me</footer>"""


def test_page():
    assert hb.main_text(PAGE) == "The énd\n\nFirst para graph <b> boldly.\n\nOne.\n\nA wholly linked line"


def test_without_article():
    text = " ".join(["word"] * 40)
    page = f"<div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div><p>{text}</p><p>{text}</p></div><div><a href=3>Next</a></div>"
    assert hb.main_text(page) == f"{text}\n\n{text}"


LONG = " ".join(["word"] * 40)
SHORT = "A short line."
BODY = f"<h1>Title</h1><p>{LONG}</p><p>{SHORT}</p>"
TEXT = f"Title\n\n{LONG}\n\n{SHORT}"


@pytest.mark.parametrize("page", [
    f"<nav><a href=1>Home</a></nav><article><h1>Title</h1><svg/><p>{LONG}</p><p>{SHORT}</p></article>",
    f"<article><h1>Title</h1><svg width='1' /><p>{LONG}</p><svg><title>x</title><path d=1></svg><p>{SHORT}</p></article>",
    f"<article><h1>Title</h1><button>Share<p>{LONG}</p><p>{SHORT}</p></article>",
    f"<article><h1>Title</h1><button>Share<p>{LONG}</p><button>x</button><p>{SHORT}</p><select><option>a<option>b</select></article>",
    f"<button>Menu<article>{BODY}</article><button>x</button>",
    f"<article><h1>Title</h1><video src=a><p>No video here.</p></video><p>{LONG}</p><p>{SHORT}<canvas>no</canvas></p></article>",
    f'<div class="layout has-sidebar"><article>{BODY}</article><div class="sidebar"><p>{LONG} side</p></div></div>',
    f'<div class="sidebar-layout"><main>{BODY}<div class="comments"><p>{LONG} comment</p></div></main></div>',
    f'<div id="sidebar-page"><article>{BODY}</article><div class="related"><article><p>Other one</p></article></div></div>',
    f'<article>{BODY}</article><div class="comments"><article class="comment"><p>{LONG} {LONG} comment</p></article></div>',
    f'<article><h1 class="related-work">Title</h1><p>{LONG}</p><h3 class="ad">Buy</h3><p>{SHORT}</p></article>',
])
def test_articles_are_whole(page):
    assert hb.main_text(page) == TEXT


@pytest.mark.parametrize("page, want", [
    (f"<div><p><a href=1>See all our offers today</a></p><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<div><p>{LONG}</p><p><a href=1>More of the same kind</a></p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><div>\u00a9 2020 The Paper. All rights reserved.</div>", f"{LONG}\n\n{LONG}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><p>Copyright by me</p>", f"{LONG}\n\n{LONG}"),
    (f"<div><p>{LONG}</p><p>Copyright was the matter. {LONG}</p></div>", f"{LONG}\n\nCopyright was the matter. {LONG}"),
    (f"<article><p>{LONG}</p><p>Copyright by me</p></article>", f"{LONG}\n\nCopyright by me"),
    (f'<div class="comments"><article><p>Nice one</p></article></div><div><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n\n{LONG}"),
])
def test_own_links_and_rights_decide_outside_articles(page, want):
    assert hb.main_text(page) == want


@pytest.mark.parametrize("page", ["", "<", "<button>" * 50_000, "<svg>" * 50_000 + "</svg>" * 50_000, "<p", "<a<a<a<a" * 20_000, "<!--" * 50_000, "<script>" * 20_000, "</div>" * 50_000,
                                  "<div>" * 50_000 + "x", "<p class='" * 20_000, "&" * 50_000, "<b " + "a=\"" * 30_000])
def test_broken_markup_is_linear(page):
    began = time.time()
    assert isinstance(hb.main_text(page), str)
    assert time.time() - began < 20


def test_table_is_fitted():
    root = hb.tree()
    for row in hb.labelled():
        node = root
        while type(node) is tuple:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        assert node == row[-1]


def test_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, PAGE, None), (3, PAGE, None), (None, "<article><p>a</p></article>", "u")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id int, html string, url string, text string")
    got = hb.extract(df, ["page_id", "url"]).collect()
    assert sorted((r.n_chars for r in got)) == sorted([0, 0, 1, *[len(hb.main_text(PAGE))] * 2])
    assert hb.extract(df.limit(0), ["page_id"]).count() == 0
