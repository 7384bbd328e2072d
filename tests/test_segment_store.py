"""Decoded source maps kept for many jobs."""

import json
import re

import pytest
from webdiag import api
from webdiag.operators import asof, sourcemaps
from webdiag.operators.segment_store import SegmentStore

BUNDLE = "https://app.example.com/dist/app.min.js"
FIXTURE_MAP = json.dumps({"version": 3, "sources": ["src/ProductList.jsx"], "names": ["fetchItems"],
                          "mappings": "AAAA,SAASA", "file": "app.min.js"})
OTHER = "https://cdn.example/x.min.js"
COLUMNS = "url string, gen_line long, gen_col long, next_gen_col long, source string, orig_line long, orig_col long, name string"


def _segments(spark, url, n=60):
    """A line of segments at columns of growing gaps, some wider than all copies; every seventh without a source."""
    cols = [k * k for k in range(n)]
    rows = [(url, line, c, cols[k + 1] if k + 1 < n else None, None if k % 7 == 3 else f"s{k}.ts", k + 1, k, None)
            for line in (1, 2) for k, c in enumerate(cols)]
    return spark.createDataFrame(rows, COLUMNS)


def _positions(spark):
    return spark.createDataFrame([(u, line, c) for u in (BUNDLE, OTHER, "gone") for line in (1, 2, 3) for c in range(0, 4000, 37)],
                                 "url string, line long, col long")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_lookup_equals_the_plain_one(spark, tmp_path):
    both = _segments(spark, BUNDLE).union(_segments(spark, OTHER, 40))
    store = SegmentStore.create(spark, str(tmp_path / "s"), width=16, copies=2)
    store.add(both)
    plain = asof.resolve_positions(_positions(spark), both, 16, 2)
    assert _rows(asof.resolve_positions(_positions(spark), store.split())) == _rows(plain)
    assert plain.where("r_source is not null").count() > 100


def test_only_new_urls_are_added(spark, tmp_path):
    store = SegmentStore.create(spark, str(tmp_path / "s"), width=16, copies=2)
    with pytest.raises(ValueError):
        store.split()
    store.add(_segments(spark, BUNDLE))
    first = store.split().copies.count()
    store.add(_segments(spark, BUNDLE))
    assert store.split().copies.count() == first
    both = _segments(spark, BUNDLE).union(_segments(spark, OTHER))
    store.add(both)
    assert _rows(store.urls()) == sorted(f"Row(url={u!r})" for u in (BUNDLE, OTHER))
    assert _rows(asof.resolve_positions(_positions(spark), store.split())) == \
        _rows(asof.resolve_positions(_positions(spark), both, 16, 2))


def test_addition_that_died_is_completed(spark, tmp_path):
    store = SegmentStore.create(spark, str(tmp_path / "s"), width=16, copies=2)
    segs = _segments(spark, BUNDLE)
    split = asof.split_segments(segs, 16, 2)
    store._append("copies", split.copies, ("s_url", "s_line", "s_bucket"))  # and no long ones
    store.add(segs)
    assert store.split().copies.count() == split.copies.count() and store.split().long.count() == split.long.count()


def test_store_is_found_again_from_its_folder(spark, tmp_path):
    path = str(tmp_path / "s")
    store = SegmentStore.create(spark, path, width=16, copies=2, buckets=6)
    segs = _segments(spark, BUNDLE)
    store.add(segs)
    store.forget()  # as a new session has it
    again = SegmentStore(spark, path)
    assert (again.width, again.copies, again.buckets) == (16, 2, 6)
    assert _rows(asof.resolve_positions(_positions(spark), again.split())) == \
        _rows(asof.resolve_positions(_positions(spark), segs, 16, 2))
    again.add(_segments(spark, OTHER))
    assert again.urls().count() == 2
    with pytest.raises(Exception):
        SegmentStore.create(spark, path)


def test_stored_side_is_not_shuffled(spark, tmp_path):
    store = SegmentStore.create(spark, str(tmp_path / "s"), width=16, copies=2)
    store.add(_segments(spark, BUNDLE))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = store.split()
        stored = asof.resolve_positions(_positions(spark), split)._jdf.queryExecution().executedPlan().toString()
        plain = asof.resolve_positions(_positions(spark), _segments(spark, BUNDLE))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # positions alone move: once by (url, line, bucket), once by (url, line)
    exchanges = [line for line in stored.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and not any("s_url" in x for x in exchanges)
    assert len(re.findall("Exchange hashpartitioning", plain)) > 2
    assert stored.count("Bucketed: true") == 2


def test_get_errors_from_the_store(spark, tmp_path):
    store = SegmentStore.create(spark, str(tmp_path / "s"))
    store.add(sourcemaps.build_segments(spark.createDataFrame([(BUNDLE, FIXTURE_MAP)], "url string, map_json string")))
    log = json.dumps([{"level": "error", "text": "boom", "stack": f"Error: boom\n    at f ({BUNDLE}:1:12)"}])
    p = spark.createDataFrame([("a", log)], "capture_id string, payload string")
    maps = spark.createDataFrame([(BUNDLE + ".map", FIXTURE_MAP)], "url string, map_json string")
    scripts = spark.createDataFrame([], "url string, body string")
    stored = api.get_errors(p, segments=store.split())
    decoded = api.get_errors(p, map_files=maps, scripts=scripts)
    assert _rows(stored.report) == _rows(decoded.report)
    assert [r.sourcemap_resolved for r in stored.summary.collect()] == [1]
