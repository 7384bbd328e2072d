"""Hot keys: one capture/fingerprint/position holding most rows, and a
segment spanning a huge column range — results stay whole and exact."""

import json

from pyspark.sql import functions as F

from webdiag.operators import asof, rollup, sourcemaps


def test_hot_capture_and_fingerprint(spark):
    e = spark.range(20000).select(F.lit("hot").alias("capture_id"), F.col("id").alias("seq"),
                                  F.lit("error").alias("level"),
                                  F.concat(F.lit("boom at 0x"), F.hex("id")).alias("text")).repartition(8)
    out = rollup.error_rollup(e, severity="error", limit=5).collect()
    assert len(out) == 1 and out[0]["count"] == 20000 and out[0].first_seq == 0
    assert out[0].message == "boom at 0x0"


def test_hot_position_and_wide_segment(spark):
    # one segment from column 0 to 1e9, then an open one after it
    m = json.dumps({"version": 3, "sources": ["a.js"], "names": [], "mappings": "AAAA,gglrz7BAAI"})
    segs = sourcemaps.build_segments(spark.createDataFrame([("u.min.js", m)], "url string, map_json string"))
    starts = sorted(r.gen_col for r in segs.collect())
    assert starts == [0, 1000000000]
    copies, long_ = asof._split_segments(segs, 64, 8)
    assert copies.count() <= 2 * 8 and long_.count() == 2
    frames = spark.range(5000).select(
        F.lit("c").alias("capture_id"), F.col("id").alias("seq"), F.lit(1).cast("bigint").alias("frame_no"),
        F.lit("f").alias("function_name"), F.lit("u.min.js").alias("url"), F.lit(1).cast("bigint").alias("line"),
        F.when(F.col("id") % 2 == 0, F.lit(777777777)).otherwise(F.lit(1500000000)).cast("bigint").alias("col"),
        F.lit(None).cast("string").alias("raw"))
    r = asof.resolve_frames(frames, segs, bucket_width=64, max_copies=8)
    got = r.groupBy("text").count().collect()
    assert sorted((x.text, x["count"]) for x in got) == [("at f (a.js:1:0)", 2500), ("at f (a.js:1:4)", 2500)]


def test_one_very_long_line_is_dealt_to_ranges(spark, monkeypatch):
    """Next positions carried over range borders equal those of one sort of the line."""
    import json
    import random
    from webdiag.operators import sourcemaps
    rnd = random.Random(2)

    def vlq(v):
        v, out = (-v << 1 | 1) if v < 0 else v << 1, ""
        while True:
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[v & 31 | (32 if v > 31 else 0)]
            v >>= 5
            if not v:
                return out
    steps = [rnd.choice([0, 1, 3, 7, 90, 2000]) for _ in range(3000)] + [200_000, 1, -5000, 4]
    mappings = ";;" + ",".join(vlq(s) + "AAA" for s in steps) + ";AAAA"
    maps = spark.createDataFrame([("u", json.dumps({"version": 3, "sources": ["a.js"], "names": [], "mappings": mappings}))],
                                 "url string, map_json string")
    cols, at = set(), 0
    for s in steps:
        at += s
        cols.add(at)
    cols = sorted(cols)
    for width in (16384, 64):
        monkeypatch.setattr(sourcemaps, "LEAD_COLUMNS", width)
        got = sourcemaps.build_segments(maps).where("gen_line = 3").orderBy("gen_col").collect()
        assert [(r.gen_col, r.next_gen_col) for r in got] == list(zip(cols, cols[1:] + [None]))
