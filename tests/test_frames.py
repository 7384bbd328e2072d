"""Stack frames and source maps: the reference's two resolver tests plus
parsing, printing, map discovery and decoding cases."""

import json

from pyspark.sql import functions as F

from webdiag.functions import urls, vlq
from webdiag.operators import asof, sourcemaps, stacks

FIXTURE_MAP = json.dumps({"version": 3, "sources": ["src/ProductList.jsx"], "names": ["fetchItems"],
                          "mappings": "AAAA,SAASA", "file": "app.min.js"})
BUNDLE = "https://app.example.com/dist/app.min.js"
OBJ = "array<struct<functionName:string,url:string,lineNumber:bigint,columnNumber:bigint>>"


def object_stack_entry(spark, col):
    return spark.createDataFrame([("c", 0, "error", "TypeError: oops", [("z", BUNDLE, 1, col)])],
                                 f"capture_id string, seq bigint, level string, text string, stack {OBJ}")


def test_resolves_through_map(spark):
    maps = spark.createDataFrame([(BUNDLE, FIXTURE_MAP)], "url string, map_json string")
    segs = sourcemaps.build_segments(maps)
    out = asof.compress_with_maps(object_stack_entry(spark, 0), segs).collect()[0]
    assert out.resolved_count == 1
    assert out.stack_trace == ["at z (src/ProductList.jsx:1:0)"]


def test_falls_back_silently_without_map(spark):
    segs = sourcemaps.build_segments(spark.createDataFrame([], "url string, map_json string"))
    out = asof.compress_with_maps(object_stack_entry(spark, 1234), segs).collect()[0]
    assert out.resolved_count == 0
    assert out.stack_trace == [f"at z ({BUNDLE}:1:1234)"]


def test_segments_of_fixture_map(spark):
    segs = sourcemaps.build_segments(spark.createDataFrame([(BUNDLE, FIXTURE_MAP)], "url string, map_json string"))
    got = [tuple(r) for r in segs.orderBy("gen_col").collect()]
    assert got == [(BUNDLE, 1, 0, 9, "src/ProductList.jsx", 1, 0, None),
                   (BUNDLE, 1, 9, None, "src/ProductList.jsx", 1, 9, "fetchItems")]


def test_asof_lookup_semantics(spark):
    m = json.dumps({"version": 3, "sources": ["a.js", "b.js"], "names": ["n"],
                    "mappings": "AAAA,UACAA,E;;gBCAA,KAAK"})
    segs = sourcemaps.build_segments(spark.createDataFrame([("u.min.js", m)], "url string, map_json string"))
    pos = spark.createDataFrame([("u.min.js", 1, c) for c in (0, 5, 10, 11, 12, 5000)] +
                                [("u.min.js", 1, 1), ("u.min.js", 2, 3), ("u.min.js", 3, 15), ("u.min.js", 3, 16),
                                 ("u.min.js", 3, 99),
                                 ("other.min.js", 1, 1)], "url string, line bigint, col bigint")
    for w, c in ((1, 1), (1, 3), (4, 1), (4, 8), (256, 8)):
        got = {(r.line, r.col): (r.r_source, r.r_line, r.r_col, r.r_name)
               for r in asof.resolve_positions(pos, segs, bucket_width=w, max_copies=c).collect()
               if r.url == "u.min.js"}
        assert got[(1, 0)] == ("a.js", 1, 0, None)
        assert got[(1, 5)] == ("a.js", 1, 0, None)
        # line 1: col 0 → a.js:1:0; col 10 → a.js:2:0 name n; col 12 → a 1-field segment
        assert got[(1, 10)] == ("a.js", 2, 0, "n")
        assert got[(1, 11)] == ("a.js", 2, 0, "n")
        assert got[(1, 12)] == (None, None, None, None)  # 1-field segment: no source
        assert got[(1, 5000)] == (None, None, None, None)
        assert got[(2, 3)] == (None, None, None, None)  # empty line
        # line 3: col 16 → b.js:2:0; col 21 → b.js:2:5 (deltas carry across lines)
        assert got[(3, 15)] == (None, None, None, None)  # before the first segment of the line
        assert got[(3, 16)] == ("b.js", 2, 0, None)
        assert got[(3, 99)] == ("b.js", 2, 5, None)
        assert got[(1, 1)] == ("a.js", 1, 0, None)
    other = asof.resolve_positions(pos, segs).where("url = 'other.min.js'").collect()
    assert len(other) == 1 and other[0].r_source is None


def test_broken_or_foreign_maps_yield_no_segments(spark):
    rows = [("a", "not json"), ("b", json.dumps({"version": 2, "sources": ["x"], "mappings": "AAAA"})),
            ("c", json.dumps({"version": 3, "sources": ["x"], "mappings": "AAAA,AA"})),
            ("d", json.dumps({"version": 3, "sources": ["x"], "names": [], "mappings": "AAAA"}))]
    segs = sourcemaps.build_segments(spark.createDataFrame(rows, "url string, map_json string"))
    assert [r.url for r in segs.collect()] == ["d"]


def test_vlq_decode(spark):
    df = spark.createDataFrame([("AAAA",), ("SAASA",), ("gBAAA",), ("D",), ("2HwBA",)], "s string")
    got = [r.f for r in df.select(vlq.decode_segment(F.col("s")).alias("f")).collect()]
    assert got == [[0, 0, 0, 0], [9, 0, 0, 9, 0], [16, 0, 0, 0], [-1], [123, 24, 0]]


def test_frame_parsing_and_compression(spark):
    stack = "\n".join(["TypeError: x is undefined", "    at render (https://h/dist/app.js:10:5)",
                       "    at g (webpack-internal:///x.js:3:4)", "", "   ",
                       "    at https://h/src/a.js:7:1", "    at h (/app/node_modules/i.js:1:1)",
                       "tail@x.js:1:2"])
    e = spark.createDataFrame([("c", 0, stack), ("c", 1, ""), ("c", 2, None),
                               ("c", 3, "at a (node_modules/x.js:1:1)")], "capture_id string, seq bigint, stack string")
    out = {r.seq: r.stack_trace for r in stacks.compress_stacks(e).collect()}
    assert out[0] == ["TypeError: x is undefined", "at render (https://h/dist/app.js:10:5)",
                      "at ? (https://h/src/a.js:7:1)"]
    assert out[1] is None and out[2] is None and out[3] is None
    parsed = stacks.explode_frames(e.where("seq = 0")).orderBy("frame_no").collect()
    assert parsed[1].function_name == "render" and parsed[1].line == 10 and parsed[1].col == 5
    assert parsed[0].url is None and parsed[0].raw == "TypeError: x is undefined"


def test_minified_gate(spark):
    from webdiag.functions.frames import looks_minified
    rows = [("https://h/a.min.js", 5, 0, True), ("https://h/a.bundle.js?v=1", 5, 0, True),
            ("https://h/dist/a.js", 5, 0, True), ("https://h/a.js", 1, 201, True), ("https://h/a.js", 1, 200, False),
            ("https://h/a.js", 2, 500, False), (None, 1, 500, False), ("https://h/_next/static/chunks/x.js", 3, 1, True),
            ("https://h/a.min.jsx", 3, 1, False)]
    df = spark.createDataFrame(rows, "url string, line bigint, col bigint, want boolean")
    for r in df.select("want", looks_minified(F.col("url"), F.col("line"), F.col("col")).alias("got")).collect():
        assert r.want == r.got


def test_url_resolution(spark):
    rows = [("../maps/a.js.map", "https://c.x/dist/app.min.js?v=1", "https://c.x/maps/a.js.map"),
            ("a.map", "https://h/x/y.js", "https://h/x/a.map"),
            ("/r/./s.map", "https://h:8080/x/y.js", "https://h:8080/r/s.map"),
            ("//c.com/m.map", "http://h/y.js", "http://c.com/m.map"),
            ("https://o/m.map", "http://h/y.js", "https://o/m.map"),
            ("..", "http://h:8080/a/b/c.js?v=2", "http://h:8080/a/"),
            ("x/.", "https://h/d/e.js", "https://h/d/x/")]
    df = spark.createDataFrame(rows, "ref string, base string, want string")
    for r in df.select("want", urls.resolve_url(F.col("ref"), F.col("base")).alias("got")).collect():
        assert r.want == r.got


def test_map_selection(spark):
    import base64
    inline = base64.b64encode(FIXTURE_MAP.encode()).decode()
    map_files = spark.createDataFrame([("https://h/dist/a.min.js.map", "not json"),
                                       ("https://h/maps/a.map", FIXTURE_MAP),
                                       ("https://h/maps/b.map", FIXTURE_MAP)], "url string, map_json string")
    scripts = spark.createDataFrame([
        ("https://h/dist/a.min.js", "x;\n//# sourceMappingURL=../maps/a.map"),
        ("https://h/dist/b.min.js", "x;\n//@ sourceMappingURL=../maps/b.map\n//# sourceMappingURL=zzz"),
        ("https://h/dist/c.min.js", f"x;//# sourceMappingURL=data:application/json;base64,{inline}"),
        ("https://h/dist/d.min.js", "no reference"),
        ("https://h/dist/e.min.js", "//# sourceMappingURL=data:application/json,{}")], "url string, body string")
    urls_df = spark.createDataFrame([(f"https://h/dist/{x}.min.js",) for x in "abcdef"] +
                                    [("https://h/dist/a.min.js?v=3",)], "url string")
    got = {r.url: (r.map_origin, r.map_url) for r in sourcemaps.select_maps(urls_df, map_files, scripts).collect()}
    assert got["https://h/dist/a.min.js"] == ("sibling", "https://h/dist/a.min.js.map")  # broken, no fall-through
    assert got["https://h/dist/a.min.js?v=3"] == ("sibling", "https://h/dist/a.min.js.map")
    assert got["https://h/dist/b.min.js"] == ("reference", "https://h/maps/b.map")
    assert got["https://h/dist/c.min.js"] == ("inline", None)
    assert got["https://h/dist/d.min.js"] == (None, None)
    assert got["https://h/dist/e.min.js"] == (None, None)
    assert got["https://h/dist/f.min.js"] == (None, None)


def test_asof_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    seg_rows, pos_rows = [], []
    for u in range(3):
        for line in (1, 2):
            starts = sorted(rnd.sample(range(0, 3000), rnd.randint(1, 25)))
            for i, s in enumerate(starts):
                nxt = starts[i + 1] if i + 1 < len(starts) else None
                src = None if rnd.random() < 0.2 else f"s{u}.js"
                seg_rows.append((f"u{u}", line, s, nxt, src, i + 1, s % 7, None))
            pos_rows += [(f"u{u}", line, rnd.randint(0, 3500)) for _ in range(40)]
    pos_rows += [("u0", 3, 5), ("zz", 1, 5)]
    segs = spark.createDataFrame(seg_rows, "url string, gen_line bigint, gen_col bigint, next_gen_col bigint, "
                                           "source string, orig_line bigint, orig_col bigint, name string")
    pos = spark.createDataFrame(sorted(set(pos_rows)), "url string, line bigint, col bigint")

    def brute(u, ln, c):
        best = None
        for r in seg_rows:
            if r[0] == u and r[1] == ln and r[2] <= c and (best is None or r[2] > best[2]):
                best = r
        return (best[4], best[5], best[6]) if best and best[4] else (None, None, None)

    want = {p: brute(*p) for p in set(pos_rows)}
    for w, c in ((1, 2), (16, 1), (64, 4), (1024, 8)):
        got = {(r.url, r.line, r.col): (r.r_source, r.r_line, r.r_col)
               for r in asof.resolve_positions(pos, segs, bucket_width=w, max_copies=c).collect()}
        assert got == want


def test_source_normalisation(spark):
    cases = [("src/./a.js", "src/a.js"), ("../x.js", "../x.js"), ("a/../../b", "../b"), ("/../a", "/a"),
             ("a//b", "a/b"), ("webpack:///./src/App.js", "webpack:///src/App.js"),
             ("http://h.com/a/../b.js", "http://h.com/b.js"), ("./", "."), ("a/..", "."), ("webpack://", "webpack://")]
    df = spark.createDataFrame(cases, "s string, want string")
    for r in df.select("want", urls.normalize_source(F.col("s")).alias("got")).collect():
        assert r.got == r.want
    m = json.dumps({"version": 3, "sourceRoot": "webpack:///", "sources": ["./src/x.js"], "mappings": "AAAA"})
    segs = sourcemaps.build_segments(spark.createDataFrame([("u", m)], "url string, map_json string"))
    assert segs.collect()[0].source == "webpack:///src/x.js"


def test_indexed_map_sections(spark):
    sec_a = {"version": 3, "sources": ["a.js"], "names": [], "mappings": "AAAA;AACA"}
    sec_b = {"version": 3, "sources": ["b.js"], "names": ["f"], "mappings": "GAAAA,KAAKA;CACA"}
    m = json.dumps({"version": 3, "sections": [{"offset": {"line": 0, "column": 0}, "map": sec_a},
                                               {"offset": {"line": 1, "column": 100}, "map": sec_b}]})
    bad = json.dumps({"version": 3, "sections": [{"offset": {"line": 0, "column": 0}, "map": sec_a},
                                                 {"offset": {"line": 5, "column": 0}, "url": "x.map"}]})
    segs = sourcemaps.build_segments(spark.createDataFrame([("u", m), ("v", bad)], "url string, map_json string"))
    pos = spark.createDataFrame([("u", 1, 7), ("u", 2, 50), ("u", 2, 101), ("u", 2, 103), ("u", 2, 104),
                                 ("u", 2, 109), ("u", 3, 0), ("u", 3, 1), ("v", 1, 0)],
                                "url string, line bigint, col bigint")
    got = {(r.url, r.line, r.col): (r.r_source, r.r_line, r.r_col, r.r_name)
           for r in asof.resolve_positions(pos, segs, bucket_width=4, max_copies=2).collect()}
    assert got[("u", 1, 7)] == ("a.js", 1, 0, None)
    assert got[("u", 2, 50)] == ("a.js", 2, 0, None)       # section a, before section b starts
    assert got[("u", 2, 101)] == (None, None, None, None)  # in section b, before its first mapping
    assert got[("u", 2, 103)] == ("b.js", 1, 0, "f")       # 'GAAAA' at column 3 of the section line
    assert got[("u", 2, 109)] == ("b.js", 1, 5, "f")       # 'KAAKA' five columns on
    assert got[("u", 3, 0)] == (None, None, None, None)    # the offset column only shifts the first line
    assert got[("u", 3, 1)] == ("b.js", 2, 5, None)        # 'CACA': column 1, next line, no name
    assert got[("v", 1, 0)] == (None, None, None, None)    # a url section fails the whole map


def test_map_selection_duplicate_hosting(spark):
    map_files = spark.createDataFrame([("https://h/a.min.js.map", FIXTURE_MAP), ("https://h/a.min.js.map", "not json")],
                                      "url string, map_json string")
    scripts = spark.createDataFrame([], "url string, body string")
    urls_df = spark.createDataFrame([("https://h/a.min.js",)], "url string")
    got = sourcemaps.select_maps(urls_df, map_files, scripts).collect()
    assert len(got) == 1 and got[0].map_origin == "sibling"


def test_maps_with_ties_and_a_guard_line(spark):
    import json

    from webdiag.operators import sourcemaps
    # at column 0 a 1-field segment, then a mapping without and one with a name; both sides of a guard line
    text = json.dumps({"version": 3, "sources": ["a.js", "b.js"], "names": ["f"], "mappings": "A,AAAA,AAAAA,CCAA"})
    maps = spark.createDataFrame([("u", text), ("v", ")]}'\n" + text)], "url string, map_json string")
    rows = sourcemaps.build_segments(maps).orderBy("url", "gen_col").collect()
    assert [(r.url, r.gen_col, r.next_gen_col, r.source, r.name) for r in rows] == [
        (u, c, n, s, m) for u in ("u", "v") for c, n, s, m in ((0, 1, "a.js", "f"), (1, None, "b.js", None))]


def test_blocks_of_a_long_line(spark, monkeypatch):
    import json

    from webdiag.operators import sourcemaps
    monkeypatch.setattr(sourcemaps, "BLOCK", 3)
    text = json.dumps({"version": 3, "sources": ["a.js"], "names": [], "mappings": ",".join(["AAAA"] + ["CAAC"] * 20) + ";" + ",".join(["CACD"] * 5)})
    rows = sourcemaps.build_segments(spark.createDataFrame([("u", text)], "url string, map_json string")).collect()
    got = sorted((r.gen_line, r.gen_col, r.orig_line, r.orig_col) for r in rows)
    assert got == [(1, i, 1, i) for i in range(21)] + [(2, i, 1 + i, 20 - i) for i in range(1, 6)]


def test_ungated_frames_stay_out_of_the_join(spark):
    from pyspark.sql import functions as F

    from webdiag.operators import asof
    frames = spark.range(1000).select(
        F.col("id").alias("capture_id"), F.lit(1).alias("frame_no"), F.lit("f").alias("function_name"),
        F.when(F.col("id") % 10 == 0, F.lit("https://h/a.min.js")).alias("url"), F.lit(1).cast("bigint").alias("line"),
        F.lit(5).cast("bigint").alias("col"), F.lit("raw text").alias("raw"))
    segs = spark.createDataFrame([("https://h/a.min.js", 1, 0, None, "s.js", 7, 2, "g")],
                                 "url string, gen_line bigint, gen_col bigint, next_gen_col bigint, source string, orig_line bigint, orig_col bigint, name string")
    got = asof.resolve_frames(frames, segs)
    rows = got.groupBy("resolved", "text").count().collect()
    assert {(r.resolved, r.text, r["count"]) for r in rows} == {(True, "at g (s.js:7:2)", 100), (False, "raw text", 900)}
