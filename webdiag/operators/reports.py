"""End-to-end reports: the console error report (get-errors) and the
element diagnosis (diagnose-element) as tables (O3.2, O3.4, O3.7, O9.3–O9.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdiag.functions import console as C
from webdiag.operators import audit, rollup, suggest
from webdiag.operators.common import as_keys

# --- fixed values (must equal the reference's for equal results) ---------
SUMMARY_TOP_CHARS = 100
SEVERITIES = ("error", "warning", "all")
LIMIT_RANGE = (1, 100)
# ------------------------------------------------------------------------


def check_error_params(severity: str, limit: int) -> None:
    """The report's parameter contract: severity error|warning|all, limit 1–100."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}, got {severity!r}")
    if not isinstance(limit, int) or not LIMIT_RANGE[0] <= limit <= LIMIT_RANGE[1]:
        raise ValueError(f"limit must be an integer in {LIMIT_RANGE}, got {limit!r}")


def error_report(entries: DataFrame, severity: str = "error", limit: int = 20, by=("capture_id",),
                 segments: DataFrame | None = None, captures: DataFrame | None = None,
                 noise_patterns=C.NOISE_PATTERNS, keep=None) -> tuple[DataFrame, DataFrame]:
    """(issues, summary). ``segments`` is a table, or a function that makes it
    from the kept issues' frames; ``keep(df, name)`` writes what several
    outputs read.

    ``issues``: the ranked rollup; with ``segments`` the kept issues' stacks
    are compressed and resolved (``stack_trace``, ``resolved_count``), else
    compressed only. ``summary``: one row per capture — total entries before
    any filter, unique issues after the limit, resolved frames, summary
    text. ``captures`` (keys only) adds captures that have no entry."""
    check_error_params(severity, limit)
    keys = as_keys(by)
    if not keys:  # one global group: a constant key keeps every step a keyed join
        key = "_all"
        entries = entries.withColumn(key, F.lit(0))
        captures = None
        issues, summary = error_report(entries, severity, limit, [key], segments, None, noise_patterns, keep)
        return issues.drop(key), summary.drop(key)
    # issues: severity pushed to the scan; totals: a count over the key
    # columns only (a narrow columnar scan of the same table)
    issues = rollup.error_rollup(entries, severity=severity, limit=limit, by=keys, noise_patterns=noise_patterns,
                                 many_captures=captures is not None)
    keep = keep or (lambda df, _name: df)
    if "stack" in issues.columns:
        if segments is not None:
            from webdiag.operators.asof import compress_with_maps
            from webdiag.operators.stacks import explode_frames
            issues = keep(issues, "kept_issues")  # at most limit per capture from here on
            if callable(segments):
                segments = segments(explode_frames(issues, [*keys, "issue_no"]))
            issues = keep(compress_with_maps(issues, segments, keys=[*keys, "issue_no"]), "issues")
        else:
            from webdiag.operators.stacks import compress_stacks
            issues = compress_stacks(issues).withColumn("resolved_count", F.lit(None).cast("bigint"))
    totals = rollup.normalize(entries, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_log_entries"))
    if captures is not None:
        # rows of captures are narrow and much alike, so by their bytes Spark would put
        # millions into one task: dealt by number the partitions are not put together
        n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        captures = captures.select(*keys).repartition(n, *keys).distinct()
        totals = captures.hint("merge").join(totals, keys, "left").fillna(0, ["total_log_entries"])
    # count, resolved frames and the top message in one aggregate (one branch)
    aggs = [F.count(F.lit(1)).alias("unique_issues"), F.min_by("message", "issue_no").alias("top_message")]
    if "resolved_count" in issues.columns:
        aggs.append(F.sum("resolved_count").alias("sourcemap_resolved"))
    per = issues.groupBy(*keys).agg(*aggs)
    s = (totals if captures is None else totals.hint("merge")).join(per, keys, "left")
    u = F.coalesce(F.col("unique_issues"), F.lit(0))
    none = "No " + ("" if severity == "all" else severity + " ") + "messages found in console."
    text = F.when(u == 0, F.lit(none)).otherwise(F.concat(
        u.cast("string"), F.lit(" unique issue"), F.when(u > 1, F.lit("s")).otherwise(F.lit("")),
        F.lit(" (from "), F.col("total_log_entries").cast("string"), F.lit(" total log entries). Top: "),
        F.substring("top_message", 1, SUMMARY_TOP_CHARS)))
    cols = [*keys, F.col("total_log_entries").cast("bigint").alias("total_log_entries"),
            u.cast("bigint").alias("unique_issues")]
    if "sourcemap_resolved" in s.columns and segments is not None:
        cols.append(F.coalesce("sourcemap_resolved", F.lit(0)).cast("bigint").alias("sourcemap_resolved"))
    return issues, s.select(*cols, text.alias("summary"))


def diagnose(requests: DataFrame, elements: DataFrame, dom_tokens: DataFrame | None = None,
             include_box_model: bool = True, keys=("capture_id",)) -> tuple[DataFrame, DataFrame]:
    """(element_report, batch_report) for requested selectors.

    ``requests(keys…, pos, selector)``; ``elements(keys…, selector, styles)``
    are the captured elements. A request without an element is a not-found
    row with suggestions from ``dom_tokens``."""
    keys = as_keys(keys)
    # one element per (keys, selector): the first in document order when the
    # table says (querySelector returns the first match), else a fixed pick
    order = F.col("doc_order") if "doc_order" in elements.columns else F.to_json("styles")
    e = elements.groupBy(*keys, "selector").agg(F.min_by("styles", order).alias("styles"))
    found = requests.join(e, [*keys, "selector"], "inner").withColumn("not_found", F.lit(False)) \
        .withColumn("suggestions", F.array().cast("array<string>"))
    if dom_tokens is not None:
        miss = suggest.not_found_rows(requests, elements, dom_tokens, keys)
    else:
        miss = suggest.lookup(requests, elements, keys).where(~F.col("found")).drop("found") \
            .withColumn("not_found", F.lit(True)).withColumn("suggestions", F.array().cast("array<string>"))
    miss = miss.withColumn("styles", F.create_map().cast("map<string,string>"))
    rows = found.unionByName(miss.select(*found.columns))
    report = audit.element_report(rows, include_box_model)
    return report, audit.batch_report(report, keys)
