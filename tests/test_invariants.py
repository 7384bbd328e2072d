"""Invariants: idempotent filter, partition-count
independence, Σ count ≤ total."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_style_filter_idempotent(spark):
    from webdiag.operators import audit
    from webdiag.sources import adapters as A
    e = A.element_styles(spark, SF)
    once = audit.filter_styles(e)
    twice = audit.filter_styles(once)
    key = lambda df: rows(df.select("selector", F.to_json("styles")))
    assert key(once) == key(twice)


def test_partition_count_independence(spark):
    from webdiag.operators import asof, audit, rollup, sourcemaps, stacks
    from webdiag.sources import adapters as A
    entries = A.console_entries(spark, SF)
    elements = A.element_styles(spark, SF)
    frames = stacks.explode_frames(A.stack_entries(spark, SF))
    mf, sc = A.map_files_and_scripts(spark, SF)
    segs = sourcemaps.segments_for_frames(frames, mf, sc)
    jobs = [
        lambda n: rollup.error_rollup(entries.repartition(n), severity="all"),
        lambda n: audit.batch_report(audit.element_report(elements.repartition(n))),
        lambda n: asof.resolve_frames(frames.repartition(n), segs.repartition(n)).select(
            "capture_id", "seq", "frame_no", "text"),
    ]
    for job in jobs:
        assert rows(job(1)) == rows(job(7))


def test_counts_within_total(spark):
    from webdiag.operators import reports
    from webdiag.sources import adapters as A
    issues, summary = reports.error_report(A.console_entries(spark, SF), severity="all", limit=100)
    per = issues.groupBy("capture_id").agg(F.sum("count").alias("s"))
    bad = per.join(summary, "capture_id").where(F.col("s") > F.col("total_log_entries"))
    assert bad.count() == 0


def test_ansi_off_null_arrays(spark):
    """Legacy size(null) = -1 with ANSI off must not leak into results."""
    from webdiag.operators import audit
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([("#x", None), ("#y", ["#y1"])], "selector string, suggestions array<string>")
        got = {r.selector: r.s for r in df.select(
            "selector", audit.not_found_summary(F.col("selector"), F.col("suggestions")).alias("s")).collect()}
        assert got["#x"] == "#x: element not found, no similar selectors detected."
        assert got["#y"] == "#y: element not found. Closest matches: #y1"
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_style_rows_equal_filtered_map(spark):
    from webdiag.operators import audit
    from webdiag.sources import adapters as A
    e = A.element_styles(spark, SF)
    for box in (True, False):
        long_form = audit.style_rows(e, include_box_model=box).select("selector", "property", "value")
        via_map = audit.filter_styles(e, include_box_model=box).select(
            "selector", F.explode("styles").alias("property", "value"))
        assert rows(long_form) == rows(via_map)
