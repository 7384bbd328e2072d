"""Main text of web pages from flat text blocks.

A page is cut into blocks: the runs of text between block-level tags. A block
has its number of words and its link density (the share of its characters in
links), those of its two neighbours, whether it is a line of rights, and what
encloses it: whether it lies in an article, and whether a tag or a name in
class, id or role marks an enclosing element as something else (menu, header,
footer, notice, advert, form, reader comments). A decision tree, grown by Gini
gain from the small labelled table below, classifies each block; the text is the
chosen blocks in page order.

Names that say how a page is laid out ("has-sidebar") mark nothing, and a
heading is marked by whole names only ("related", not "related-work"). Where
names mark the wrappers of every article of a page, the article with the most
words counts as unmarked if it has more of them than the rest of the page.
Buttons, drawings and other elements without page text end at their end tag;
without one they end at the next block, so that nothing else is lost.

Rows: null or empty html, and html without a chosen block, give the empty
text; any broken markup gives some text, in time linear in its length;
repeated rows give a row each; an empty table gives none. Columns other than
those named are not read.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, map_arrow, table, whole_text

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "marked", "rights")

# The labelled table: blocks of pages written for it, FEATURES but the last and
# whether the block is main text. Fixed values.
LABELLED = (
    # in an article, not marked: titles, paragraphs of all lengths, wholly linked lines
    (6, .0, 5, 1., 40, .0, 1, 0, 1), (12, .0, 8, .0, 55, .0, 1, 0, 1), (1, .0, 12, .0, 80, .0, 1, 0, 1),
    (2, .0, 90, .0, 3, .0, 1, 0, 1), (3, 1., 60, .0, 70, .0, 1, 0, 1), (45, .1, 6, .0, 30, .2, 1, 0, 1),
    (120, .0, 45, .0, 10, .0, 1, 0, 1), (30, .4, 25, .0, 1, .0, 1, 0, 1), (9, .0, 1, 1., 1, 1., 1, 0, 1),
    (15, .9, 20, .0, 11, 1., 1, 0, 1), (400, .0, 0, .0, 0, .0, 1, 0, 1), (1, 1., 0, .0, 0, .0, 1, 0, 1),
    # marked as something else, in an article or not
    (1, 1., 1, 1., 1, 1., 0, 1, 0), (2, 1., 0, .0, 1, 1., 0, 1, 0), (9, .0, 1, 1., 14, .0, 0, 1, 0),
    (25, .0, 2, 1., 8, .0, 0, 1, 0), (60, .0, 70, .0, 0, .0, 0, 1, 0), (14, .1, 90, .0, 0, .0, 0, 1, 0),
    (30, .0, 50, .0, 22, .0, 1, 1, 0), (8, .0, 45, .0, 60, .0, 1, 1, 0), (90, .0, 30, .0, 85, .0, 1, 1, 0),
    (3, 1., 70, .0, 40, .0, 1, 1, 0), (150, .0, 160, .0, 140, .0, 0, 1, 0), (5, .0, 6, .0, 2, .0, 1, 1, 0),
    # neither: long text with few links beside text is main text, short or linked lines are not
    (60, .0, 40, .0, 70, .0, 0, 0, 1), (35, .1, 60, .0, 45, .0, 0, 0, 1), (80, .0, 5, .0, 0, .0, 0, 0, 1),
    (25, .0, 90, .0, 30, .1, 0, 0, 1), (18, .0, 40, .0, 55, .0, 0, 0, 1), (7, .0, 50, .0, 65, .0, 0, 0, 1),
    (4, .0, 70, .0, 35, .0, 0, 0, 1), (8, .0, 2, 1., 90, .0, 0, 0, 1), (50, .2, 0, .0, 0, .0, 0, 0, 1),
    (12, .0, 30, .0, 4, .0, 0, 0, 1), (40, .0, 40, .0, 1, 1., 0, 0, 1), (28, .0, 1, 1., 33, .0, 0, 0, 1),
    (70, .1, 2, 1., 1, 1., 0, 0, 1), (22, .0, 3, 1., 2, 1., 0, 0, 1), (300, .0, 1, .0, 2, .0, 0, 0, 1),
    (10, .0, 45, .0, 38, .0, 0, 0, 1), (5, .0, 33, .0, 41, .0, 0, 0, 1),
    (2, 1., 1, 1., 2, 1., 0, 0, 0), (6, .9, 3, 1., 4, 1., 0, 0, 0), (1, .0, 1, 1., 1, 1., 0, 0, 0),
    (5, .0, 2, 1., 1, 1., 0, 0, 0), (3, .0, 0, .0, 2, .0, 0, 0, 0), (4, .0, 3, .0, 2, .0, 0, 0, 0),
    (20, .8, 5, 1., 6, .7, 0, 0, 0), (40, .9, 20, .8, 3, 1., 0, 0, 0), (1, 1., 60, .0, 50, .0, 0, 0, 0),
    (2, .0, 3, .5, 1, .9, 0, 0, 0), (10, 1., 80, .0, 2, 1., 0, 0, 0), (3, .0, 40, .0, 1, 1., 0, 0, 0),
    (30, 1., 25, 1., 28, 1., 0, 0, 0), (4, .0, 6, .0, 5, .0, 0, 0, 0), (9, .0, 4, 1., 6, 1., 0, 0, 0),
    # neither: wholly linked lines before, between and after text
    (3, 1., 3, 1., 60, .0, 0, 0, 0), (4, 1., 0, .0, 45, .0, 0, 0, 0), (8, 1., 55, .0, 70, .0, 0, 0, 0),
    (12, .9, 2, 1., 90, .0, 0, 0, 0), (25, 1., 60, .0, 0, .0, 0, 0, 0), (6, .8, 80, .0, 40, .1, 0, 0, 0),
)
# Lines of rights: FEATURES and whether the block is main text. Fixed values.
LABELLED_RIGHTS = (
    (4, .0, 70, .0, 0, .0, 0, 0, 1, 0), (9, .2, 40, .0, 3, 1., 0, 0, 1, 0), (14, .0, 2, 1., 0, .0, 0, 0, 1, 0),
    (7, .0, 60, .0, 55, .0, 0, 0, 1, 0), (22, .1, 90, .0, 1, 1., 0, 0, 1, 0), (5, .0, 0, .0, 0, .0, 0, 0, 1, 0),
    (60, .0, 50, .0, 45, .0, 0, 0, 1, 1), (90, .0, 6, .0, 70, .1, 0, 0, 1, 1), (45, .0, 80, .0, 30, .0, 0, 0, 1, 1),
    (70, .0, 40, .0, 60, .0, 1, 0, 1, 1), (12, .0, 30, .0, 25, .0, 1, 0, 1, 1), (6, .0, 50, .0, 0, .0, 1, 0, 1, 1),
    (8, .0, 40, .0, 0, .0, 1, 1, 1, 0), (50, .0, 60, .0, 40, .0, 0, 1, 1, 0),
)

# Elements without text of the page that hold other elements. (The content of
# scripts, styles and the like is not markup: see TOKEN.)
SILENT = frozenset("template select button svg math object canvas audio video".split())
UNNESTED = frozenset(("select", "button"))
FOREIGN = frozenset(("svg", "math"))
# Elements that mark their content as something else than main text.
MARKED = frozenset("nav footer aside form menu dialog".split())
MARKED_OUTSIDE_ARTICLE = frozenset(("header",))
MAIN = frozenset(("article", "main"))
# Names in class, id or role that do so.
MARKED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "consent contentinfo cookie cookies copyright dialog disqus discussion footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe "
    "toolbar widget widgets".split())
# "article-header", "post-header", "page-header entry": a title's wrapper, not a page header
TITLE_NAMES = frozenset("article post entry story content".split())
# "has-sidebar", "no-footer": how a page is laid out
LAYOUT_NAMES = frozenset("has with no without hide show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RIGHTS = re.compile(r"\W*(?:\u00a9|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I | re.S)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "option"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|iframe)"
    r"(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
HAS_SILENT = re.compile(rf"<(?:{'|'.join(sorted(SILENT))})\b", re.I)


def _named(tag: str, attrs: str) -> bool:
    """Whether a name in class, id or role says something else than main text."""
    for m in NAMED.finditer(attrs):
        value = next(v for v in m.groups() if v is not None)
        for name in value.lower().split() if tag in HEADINGS else value.split():
            if tag in HEADINGS:
                if name in MARKED_NAMES:
                    return True
                continue
            listed = [p.lower() for p in PARTS.findall(name)]
            if listed and listed[0] in LAYOUT_NAMES:
                continue
            parts = {*listed, name.lower()}
            found = parts & MARKED_NAMES
            if found and not (found <= {"header", "notice"} and parts & TITLE_NAMES):
                return True
    return False


def _silent_ends(page: str) -> dict[int, int]:
    """Where each silent element that has an end tag ends, by its start. An
    article begins or ends in none of them."""
    ends: dict[int, int] = {}
    if not HAS_SILENT.search(page):
        return ends
    opened: dict[str, list[int]] = {}
    for m in TOKEN.finditer(page):
        tag = (m["tag"] or "").lower()
        if tag in MAIN:
            opened.clear()
        elif tag in SILENT:
            held = opened.setdefault(tag, [])
            if m["close"]:
                if held:
                    ends[held.pop()] = m.end()
            elif tag in FOREIGN and m["attrs"].endswith("/"):
                ends[m.start()] = m.end()
            else:
                if tag in UNNESTED:
                    held.clear()
                held.append(m.start())
    return ends


def blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, link density, in an article, marked) of each block of a page."""
    out: list[tuple[str, float, int, int]] = []
    # open elements other than inline ones: what each adds to the marks by tag and by name
    stack: list[tuple[str, int, int]] = []
    article = marked = named = link = 0
    # of the outermost article: its number, names that mark what encloses it, and whether a tag or its own name does so
    inside = outer = barred = 0
    hidden: list[tuple[int, int]] = []  # (block, article) where only names around the article mark it
    free = False  # an article with nothing marked around it was met
    text: list[str] = []
    linked = 0
    ends = _silent_ends(page)
    until, hush = 0, False

    def end_block():
        nonlocal text, linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                if article and outer and not barred and not marked and named == outer:
                    hidden.append((len(out), inside))
                out.append((line, min(1.0, linked / len(line)), int(article > 0), int(marked + named > 0)))
            text, linked = [], 0

    def add(raw: str):
        nonlocal linked
        raw = html.unescape(raw) if "&" in raw else raw
        text.append(raw)
        if link:
            linked += len(raw.strip())

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < until:
            continue
        if m.start() > at and not hush:
            add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() in ("title",):
                end_block()
            continue
        tag = tag.lower()
        if tag in SILENT:
            if m["close"]:
                hush = False
            elif m.start() in ends:
                until = at = ends[m.start()]
            else:
                hush = True
            continue
        if hush:
            if tag not in BLOCK or tag in ("option", "optgroup"):
                continue
            hush = False
        if tag == "a":
            link = 0 if m["close"] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            end_block()
            link = 0
            if tag in VOID:
                continue
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        for name, by_tag, by_name in stack[k:]:
                            marked -= by_tag
                            named -= by_name
                            article -= name in MAIN
                        del stack[k:]
                        break
                    if stack[k][0] in MAIN and tag not in ("body", "html"):
                        break  # a stray end tag doesn't close the article around it
            else:
                while stack and stack[-1][0] in CLOSED_BY_BLOCK and tag == stack[-1][0]:
                    _, by_tag, by_name = stack.pop()
                    marked -= by_tag
                    named -= by_name
                by_tag = int(tag in MARKED or tag in MARKED_OUTSIDE_ARTICLE and not article)
                says = bool(m["attrs"]) and not by_tag and tag not in ("body", "html") and _named(tag, m["attrs"])
                if tag in MAIN:
                    if not article:
                        inside, outer, barred = inside + 1, named, bool(says or marked)
                        free = free or not (named or marked)
                    says = False
                stack.append((tag, by_tag, int(says)))
                marked += by_tag
                named += says
                article += tag in MAIN
    if at < len(page) and not hush:
        add(page[at:])
    end_block()
    if hidden and not free:
        words: dict[int, int] = {}
        for block, number in hidden:
            words[number] = words.get(number, 0) + len(out[block][0].split())
        best = max(words, key=lambda k: (words[k], -k))
        if words[best] > sum(len(b[0].split()) for b in out if not b[3]):
            for block, number in hidden:
                if number == best:
                    out[block] = (*out[block][:3], 0)
    return out


def labelled() -> list[tuple]:
    """The rows of both tables: FEATURES and the class."""
    return [tuple(map(float, r[:-1])) + (r[-1],) for r in (*((*r[:-1], 0, r[-1]) for r in LABELLED), *LABELLED_RIGHTS)]


@functools.cache
def tree():
    """The decision tree: (feature, threshold, low branch, high branch) or a class."""
    def gini(rows):
        p = sum(r[-1] for r in rows) / len(rows)
        return len(rows) * p * (1 - p)

    def grow(rows):
        if len({r[-1] for r in rows}) == 1:
            return rows[0][-1]
        best = None
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2
                low, high = [r for r in rows if r[f] <= t], [r for r in rows if r[f] > t]
                score = gini(low) + gini(high)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, t, low, high)
        if best is None:
            return int(2 * sum(r[-1] for r in rows) >= len(rows))
        return best[1], best[2], grow(best[3]), grow(best[4])

    return grow(labelled())


def main_text(page: str) -> str:
    """The main text: chosen blocks, two line feeds between them."""
    got = blocks(page)
    root = tree()
    words = [0, *(len(b[0].split()) for b in got), 0]
    links = [0.0, *(b[1] for b in got), 0.0]
    out = []
    for k, (text, _, article, marked) in enumerate(got, 1):
        row = (words[k], links[k], words[k - 1], links[k - 1], words[k + 1], links[k + 1], article, marked,
               int(RIGHTS.match(text) is not None))
        node = root
        while type(node) is tuple:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            out.append(text)
    return "\n\n".join(out)


def extract(df: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with text and n_chars of each page's main text."""
    src = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], whole_text(F.col(html_col)).alias("html"))
    kinds = [k for _, k in src.dtypes[:-1]]

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, 256):
                texts = [main_text(p) for p in part.column(len(kinds)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*[f"k{i}" for i in range(len(kinds))], "text", "n_chars"])

    out = map_arrow(src, run, ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), "text string, n_chars long"]))
    return out.toDF(*keep, "text", "n_chars")


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
