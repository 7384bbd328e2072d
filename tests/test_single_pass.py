"""Costly steps that a plan holds once (findings F1–F8)."""

from pyspark.sql import functions as F

from webdiag.functions import frames
from webdiag.operators import stacks


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_stack_is_searched_for_frames_once(spark):
    e = spark.createDataFrame([("c", 1, "Error: x\n\t at f (https://h/a.js:1:2)\n at g (webpack-internal:///x.js:3:4)\n\n"
                                "at https://h/b (c).js:5:6\nat  a b ( c) (u:7:8) \nat f (u:1:99999999999999999999)")],
                              "capture_id string, seq bigint, stack string")
    c = stacks.compress_stacks(e)
    c = c.select("seq", F.array_size("stack_trace").alias("n"), F.array_join("stack_trace", "\n").alias("t"))
    assert plan_of(c).count(r"(\d+):(\d+)") == 1
    row = c.first()
    assert (row.n, row.t) == (3, "Error: x\nat f (https://h/a.js:1:2)\nat https://h/b (c).js:5:6")
    parsed = e.select(F.explode(stacks.parsed_frames(e)).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in parsed[-2:]] == [("a b ( c)", "u", 7, 8, "at  a b ( c) (u:7:8)"),
                                               ("f", "u", 1, None, "at f (u:1:99999999999999999999)")]
    assert parsed[2].url == "webpack-internal:///x.js" and len(parsed) == 6


def test_blank_and_spaced_texts_are_no_frames(spark):
    rows = spark.createDataFrame([(["", " \t", None, " x", " at u:1:2 ", "at u:1:2\n"],)], "s array<string>")
    got = rows.select(F.explode(frames.parse_text_frames(F.col("s"))).alias("f")).select("f.*").collect()
    assert [r.raw for r in got] == [None, None, None, "x", " at u:1:2", "at u:1:2"]
    assert [r.url for r in got] == [None, None, None, None, "u", "u"]


def test_maps_are_parsed_once_and_decoded_in_blocks(spark, monkeypatch):
    import json
    from webdiag.operators import sourcemaps
    doc = lambda mappings: json.dumps({"version": 3, "sources": ["a.js", "b.js"], "names": ["n"], "mappings": mappings})
    index = json.dumps({"version": 3, "sections": [{"offset": {"line": 2, "column": 5}, "map": json.loads(doc("CAAA,ECAA;E"))}]})
    maps = spark.createDataFrame([("u", doc("AAAAA,KCCE;;AADF,,gBAAA,E")), ("v", doc("AAAA,g")), ("w", doc("AAAAA")), ("x", doc("AA")),
                                  ("y", doc("A A")), ("z", index), ("e", doc(""))], "url string, map_json string")
    want = [("u", 1, 0, 5, "a.js", 1, 0, "n"), ("u", 1, 5, None, "b.js", 2, 2, None), ("u", 3, 0, 16, "b.js", 1, 0, None),
            ("u", 3, 16, 18, "b.js", 1, 0, None), ("u", 3, 18, None, None, None, None, None), ("w", 1, 0, None, "a.js", 1, 0, "n"),
            ("z", 3, 5, 6, None, None, None, None), ("z", 3, 6, 8, "a.js", 1, 0, None), ("z", 3, 8, None, "b.js", 1, 0, None),
            ("z", 4, 2, None, None, None, None, None)]
    for block in (1 << 19, 4):
        monkeypatch.setattr(sourcemaps, "BLOCK", block)
        kept = []

        def keep(df, name):
            kept.append((name, df))
            return df.localCheckpoint()
        d = sourcemaps.build_segments(maps, keep)
        assert sorted(map(tuple, d.collect()), key=lambda r: r[:3]) == want
        assert [plan_of(df).count("from_json") for _, df in kept] == [1, 0] and "from_json" not in plan_of(d)


def test_a_style_map_is_made_once(spark):
    from webdiag.operators import audit
    e = spark.range(2).select(F.lit("c").alias("capture_id"), F.col("id").cast("string").alias("selector"), F.map_from_entries(
        F.filter(F.array(F.struct(F.lit("margin"), F.lit("1px")), F.struct(F.lit("display"), F.when(F.col("id") == 0, "none"))),
                 lambda x: x["col2"].isNotNull())).alias("styles"))
    rows = audit.style_rows(e, include_box_model=False)
    assert plan_of(rows).count("map_from_entries") == 1
    assert [tuple(r) for r in rows.collect()] == [("c", "0", "display", "none")]
    empty = spark.sql("select 'c' as capture_id, 's' as selector, cast(map() as map<string,string>) as styles union all select 'c', 's', null")
    assert audit.style_rows(empty).count() == 0
