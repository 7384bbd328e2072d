"""Sinks: JSON report envelopes and table writes.

The reference answers with a JSON text ``{"summary", "details"}``; here the
same envelope is one JSON document per capture (compact, not indented),
built with ``to_json`` from the report tables. Issue lists are bounded by
the rollup limit, so collecting them per capture is bounded too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdiag.operators.common import as_keys

JSON_OPTIONS = {"ignoreNullFields": "false"}


def error_report_json(issues: DataFrame, summary: DataFrame, by=("capture_id",)) -> DataFrame:
    """keys…, report: ``{"summary", "details": {"total_log_entries",
    "unique_issues": [{level, message, count, source, stackTrace}],
    "_sourcemap_resolved"?}}`` per capture (issues in rank order)."""
    keys = as_keys(by)
    st = F.col("stack_trace") if "stack_trace" in issues.columns else F.lit(None).cast("array<string>")
    item = F.struct(F.col("issue_no"), F.struct(
        F.col("level").alias("level"), F.col("message").alias("message"), F.col("count").alias("count"),
        F.col("source").alias("source"), st.alias("stackTrace")).alias("issue"))
    lists = issues.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    lists = lists.select(*keys, F.transform("_items", lambda x: x["issue"]).alias("_issue_list"))
    s = summary.join(lists, keys, "left")
    details = [F.col("total_log_entries").alias("total_log_entries"),
               F.coalesce(F.col("_issue_list"), F.array().cast(lists.schema["_issue_list"].dataType))
               .alias("unique_issues")]
    if "sourcemap_resolved" in summary.columns:
        details.append(F.col("sourcemap_resolved").alias("_sourcemap_resolved"))
    doc = F.struct(F.col("summary").alias("summary"), F.struct(*details).alias("details"))
    return s.select(*keys, F.to_json(doc, JSON_OPTIONS).alias("report"))


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Write a report table as parquet (optionally partitioned)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_keys(partition_by))
    w.parquet(path)


def _element_details_json(report: DataFrame):
    """JSON text of one element's details: found → {selector, issues,
    styles}; not found → {selector, not_found, suggestions}. An issue's
    missing note is left out, as JSON.stringify leaves out undefined."""
    found = F.to_json(F.struct(F.col("selector").alias("selector"), F.col("issues").alias("issues"),
                               F.col("styles").alias("styles")))
    none = F.array().cast("array<string>")  # a report of captured elements only has no suggestions
    missing = F.to_json(F.struct(F.col("selector").alias("selector"), F.lit(True).alias("not_found"),
                                 (F.coalesce(F.col("suggestions"), none) if "suggestions" in report.columns else none)
                                 .alias("suggestions")), JSON_OPTIONS)
    return F.when(F.col("is_not_found"), missing).otherwise(found)


def _open_json(**fields):
    """JSON object text of the given columns without its closing brace."""
    head = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), JSON_OPTIONS)
    return F.substring(head, 1, F.length(head) - 1)


def warning_json(quarantine: DataFrame, by=("capture_id",)) -> DataFrame:
    """keys…, report: ``{"_warning", "raw"}`` of captures that failed; ``raw``
    is the payload as it came, as JSON if it is JSON and else as a string."""
    raw = F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise(
        F.regexp_extract(F.to_json(F.struct(F.col("raw").alias("r")), JSON_OPTIONS), r"(?s)^\{\"r\":(.*)\}$", 1))
    doc = F.concat(_open_json(_warning=F.col("warning")), F.lit(',"raw":'), raw, F.lit("}"))
    return quarantine.select(*as_keys(by), doc.alias("report"))


def diagnose_json(report: DataFrame, batch: DataFrame, by=("capture_id",), single=None) -> DataFrame:
    """keys…, report: the diagnosis envelope, one document per row of
    ``batch``. ``single`` (a DataFrame of keys…, is_single) marks captures
    asked with one selector string rather than a list: those answer
    ``{summary, details}`` of their one element; all others ``{summary: batch
    summary, details: {results}}``, with an empty list where no element came.

    A capture's elements stand in one document, so their number is bounded
    beforehand: ``api.diagnose_element`` rejects requests of more than 20
    selectors, as the reference does."""
    keys = as_keys(by)
    items = report.select(*keys, "pos", "summary", _element_details_json(report).alias("_d"))
    g = items.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "_d"))).alias("_items"),
        F.min_by(F.struct("summary", "_d"), F.struct("pos", "_d")).alias("_first"))
    g = batch.select(*keys, F.col("summary").alias("_batch_summary")).join(g, keys, "left")
    if single is not None:
        g = g.join(single.select(*keys, "is_single"), keys, "left")
    else:
        g = g.withColumn("is_single", F.lit(False))
    listed = F.coalesce(F.array_join(F.transform("_items", lambda x: x["_d"]), ","), F.lit(""))
    batch_doc = F.concat(_open_json(summary=F.col("_batch_summary")), F.lit(',"details":{"results":['), listed, F.lit("]}}"))
    single_doc = F.concat(_open_json(summary=F.col("_first.summary")), F.lit(',"details":'), F.col("_first._d"), F.lit("}"))
    is_single = F.coalesce("is_single", F.lit(False)) & F.col("_first").isNotNull()
    return g.select(*keys, F.when(is_single, single_doc).otherwise(batch_doc).alias("report"))
