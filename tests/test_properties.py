"""Property tests: Spark expressions against small Python renderings of
the JavaScript semantics, on generated strings."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webdiag.functions import console as C
from webdiag.functions import css, frames

ALPHABET = "0123456789abcdefxX: .-_éAZ()@/"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=40)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def js_fingerprint(level, msg):
    s = re.sub(r"0x[0-9a-f]+", "0x?", msg, flags=re.I)
    s = re.sub(r":\d+:\d+", ":?:?", s)
    s = re.sub(r"\b\d{5,}\b", "?", s, flags=re.ASCII)
    return f"{level}::{s[:200]}"


def js_parse_float(s):
    m = re.match(r"[ \t\n\r\f\v]*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))", s)
    return float(m.group(1).replace("Infinity", "inf")) if m else math.nan


JS_FRAME = re.compile(r"at\s+(?:(.+?)\s+\()?([^()\s]+?):(\d+):(\d+)\)?\Z", re.ASCII)


def js_frame(line):
    s = line.strip(" \t\n\r\f\v")
    if not s:
        return None
    m = JS_FRAME.search(s)
    if m:
        return (m.group(1), m.group(2), int(m.group(3)), int(m.group(4)), s)
    return (None, None, None, None, s)


@SETTINGS
@given(texts)
def test_fingerprint_matches_js(spark, msgs):
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r.f for r in df.select(C.fingerprint(F.lit("warn"), F.col("m")).alias("f")).collect()]
    assert got == [js_fingerprint("warn", m) for m in msgs]


floats = st.lists(st.one_of(st.text(alphabet="0123456789.eE+- pxInfity", max_size=12),
                            st.floats(allow_nan=False).map(repr)), min_size=1, max_size=40)


@SETTINGS
@given(floats)
def test_parse_float_matches_js(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.f for r in df.select(css.parse_float(F.col("v")).alias("f")).collect()]
    for v, g in zip(vals, got):
        want = js_parse_float(v)
        assert (g is None and math.isnan(want)) or g == want, (v, g, want)


frame_lines = st.lists(st.builds(
    lambda pre, name, url, a, b, close: f"{pre}at {name}{url}:{a}:{b}{close}",
    st.sampled_from(["", "  ", "x ", "\t"]), st.sampled_from(["", "fn (", "a b (", "new X (", "(", "f("]),
    st.text(alphabet="abc/.:-x", min_size=0, max_size=12), st.integers(0, 99999), st.integers(0, 999),
    st.sampled_from(["", ")", ") ", "))", " x"])) | st.text(alphabet="at ():/.1x\t", max_size=20),
    min_size=1, max_size=30)


@SETTINGS
@given(frame_lines)
def test_frame_parse_matches_js(spark, lines):
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    got = [r.f for r in df.select(frames.parse_text_frame(F.col("s")).alias("f")).collect()]
    for s, g in zip(lines, got):
        want = js_frame(s)
        if want is None:
            assert g is None, s
        else:
            assert (g.function_name, g.url, g.line, g.col, g.raw) == want, (s, g, want)


JS_NOISE = [re.compile(p, re.ASCII) for p in (
    r'^Warning: Each child in a list should have a unique "key" prop',
    r"^Warning: React does not recognize the `\w+` prop on a DOM element",
    r"^\[HMR\]", r"^\[vite\]", r"^Download the React DevTools",
    r"^Warning: ReactDOM.render is no longer supported")] + [
    re.compile(r"is deprecated and will be removed", re.I | re.ASCII), re.compile(r"^\[webpack\]", re.ASCII)]
FRAGMENTS = ['Warning: Each child in a list should have a unique "key" prop', "Warning: React does not recognize the `",
             "onClick", "` prop on a DOM element", "[HMR]", "[vite]", "[webpack]", "Download the React DevTools",
             "Warning: ReactDOM.render is no longer supported", "Warning: ReactDOMxrender is no longer supported",
             "is DEPRECATED and will be removed", " ", "x", "\n", "é"]
noise_msgs = st.lists(st.lists(st.sampled_from(FRAGMENTS), max_size=4).map("".join), min_size=1, max_size=40)


@SETTINGS
@given(noise_msgs)
def test_noise_matches_js(spark, msgs):
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r.n for r in df.select(C.is_noise(F.col("m")).alias("n")).collect()]
    assert got == [any(p.search(m) for p in JS_NOISE) for m in msgs]


JS_INTERNAL = re.compile(r"node_modules|webpack-internal")
url_parts = st.lists(st.sampled_from(["https://h", "/dist/", "/build", "/_next/static/chunks/", "a", ".min", ".js",
                                      ".bundle", ".chunk", "?v=1", "node_modules", "webpack-internal:", "\n", "/"]),
                     max_size=6).map("".join)


@SETTINGS
@given(st.lists(url_parts, min_size=1, max_size=40))
def test_url_gates_match_js(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(frames.looks_minified(F.col("u"), F.lit(2), F.lit(0)).alias("m"),
                    F.col("u").rlike(frames.INTERNAL_RE).alias("i")).collect()
    for u, r in zip(urls, got):
        # JavaScript's $ (no m flag) is the end of input; an empty url is falsy
        assert r.m == (bool(u) and _js_min(u)), u
        assert r.i == bool(JS_INTERNAL.search(u)), u


def _js_min(u):
    """JS test of the minified-url pattern ($ = end of input only)."""
    return re.search(r"\.(min|bundle|chunk)\.js(\?|\Z)|/dist/|/build/|/_next/static/chunks/", u) is not None


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["//# sourceMappingURL=", "//@ sourceMappingURL=", "//#  sourceMappingURL=",
                                          "a.map", "data:x;base64,eyJ9", " ", "\n", "var x;", "/"]),
                         max_size=5).map("".join), min_size=1, max_size=40))
def test_map_reference_matches_js(spark, bodies):
    from webdiag.operators import sourcemaps
    df = spark.createDataFrame([(f"u{i}", b) for i, b in enumerate(bodies)], "url string, body string")
    got = {r.url: r.ref for r in sourcemaps.map_references(df).collect()}
    for i, b in enumerate(bodies):
        m = re.search(r"//[#@]\s*sourceMappingURL=(\S+)", b, re.ASCII)
        assert got[f"u{i}"] == (m.group(1) if m else None), b


# left out: refs with '//' — at the start with no host WHATWG rejects them; inside a path WHATWG keeps
# the empty segment while urljoin collapses it, so urljoin is no oracle there
ref_parts = st.lists(st.sampled_from(["a", "b.map", "..", ".", "/", "x/", "?q=1", "#f", "c.js"]), min_size=1,
                     max_size=6).map("".join).filter(lambda r: "//" not in r)
bases = st.sampled_from(["https://h.example/dist/app.min.js", "http://h:8080/a/b/c.js?v=2",
                         "https://h.example/x/y/", "https://h.example/app.js#top"])


@SETTINGS
@given(st.lists(st.tuples(ref_parts, bases), min_size=1, max_size=30))
def test_resolve_url_matches_urljoin(spark, pairs):
    from urllib.parse import urljoin
    from webdiag.functions import urls
    df = spark.createDataFrame(pairs, "ref string, base string")
    got = [r.u for r in df.select(urls.resolve_url(F.col("ref"), F.col("base")).alias("u")).collect()]
    for (ref, base), g in zip(pairs, got):
        assert g == urljoin(base, ref), (ref, base, g)
