"""The reference's two operations over tables of captures.

``get_errors``: console payloads (one JSON reply per capture) → ranked
issues, per-capture summary and JSON envelope. ``diagnose_element``:
requested selectors + style payloads (or element rows) → element and batch
reports and JSON envelopes. Both are lazy DataFrame pipelines; keys default
to ``capture_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdiag.operators import audit, reports, sourcemaps, suggest
from webdiag.operators.asof import SplitSegments
from webdiag.operators.common import as_keys, top_k, where_computed
from webdiag.session import materialize, plain_unions
from webdiag.sources import payloads, sinks

_ALL = "_all"  # the key of one global group


@dataclass
class ErrorsResult:
    issues: DataFrame      # by…, issue_no, level, message, count, source, first_seq, fingerprint, stack_trace…
    summary: DataFrame     # by…, total_log_entries, unique_issues[, sourcemap_resolved], summary
    report: DataFrame      # by…, report (JSON text); failed captures answer with their warning
    quarantine: DataFrame  # by…, source, warning, raw (whole) — payloads whose shape was not understood


@dataclass
class DiagnoseResult:
    elements: DataFrame    # one row per requested selector
    batch: DataFrame       # one row per capture
    report: DataFrame      # by…, report (JSON text)
    quarantine: DataFrame  # by…, source, warning, raw; of a request with too many selectors raw lists the first ones
    rejected: DataFrame    # by…, pos, selector of requests with too many selectors, every one


def get_errors(console_payloads: DataFrame, severity: str = "error", limit: int = 20,
               resolve_sourcemaps: bool = True, map_files: DataFrame | None = None,
               scripts: DataFrame | None = None, by=("capture_id",), write_intermediate: bool = True,
               segments: DataFrame | SplitSegments | None = None) -> ErrorsResult:
    """``console_payloads(by…, payload)`` → errors report. With
    ``resolve_sourcemaps`` minified frames are looked up in the maps found
    through ``map_files(url, map_json)`` / ``scripts(url, body)``; without
    those tables no frame resolves (the reference's resolver finding no
    map), which still prints empty stacks as ``[]`` and reports 0 resolved.
    ``segments`` are maps decoded before — a segment table, or what a
    ``SegmentStore`` keeps for many jobs — and are looked up instead.

    ``write_intermediate``: the parsed payloads and the segment table feed
    several outputs; they are written once to the shared checkpoint folder
    (``spark.checkpoint.dir``) and read back, which cuts the lineage too."""
    keys = as_keys(by)
    plain_unions(console_payloads.sparkSession)
    if not keys:  # one global group
        r = get_errors(console_payloads.withColumn(_ALL, F.lit(0)), severity, limit, resolve_sourcemaps, map_files, scripts,
                       [_ALL], write_intermediate, segments)
        return ErrorsResult(*[df.drop(_ALL) for df in (r.issues, r.summary, r.report, r.quarantine)])
    keep = materialize if write_intermediate else (lambda df, _name: df)
    parsed = keep(payloads.parse_console_payloads(console_payloads, keys), "console_payloads")
    ok = where_computed(parsed, F.col("payload_kind") != "failed").select(*keys)
    entries = payloads.console_entries(parsed, keys)
    if not resolve_sourcemaps:
        segments = None
    elif segments is None:
        if map_files is not None and scripts is not None:
            def segments(frames):  # maps of the kept issues' frames only
                return keep(sourcemaps.segments_for_frames(frames, map_files, scripts, keep), "segments")
        else:
            segments = console_payloads.sparkSession.createDataFrame(
                [], "url string, gen_line bigint, gen_col bigint, next_gen_col bigint, "
                    "source string, orig_line bigint, orig_col bigint, name string")
    issues, summary = reports.error_report(entries, severity=severity, limit=limit, by=keys,
                                           segments=segments, captures=ok, keep=keep)
    quarantine = payloads.quarantine(parsed, keys, "console")
    report = sinks.error_report_json(issues, summary, keys).unionByName(sinks.warning_json(quarantine, keys))
    return ErrorsResult(issues, summary, report, quarantine)


def diagnose_element(requests: DataFrame | None = None, style_payloads: DataFrame | None = None,
                     elements: DataFrame | None = None, dom_tokens: DataFrame | None = None,
                     include_box_model: bool = True, single: DataFrame | None = None,
                     by=("capture_id",), write_intermediate: bool = True,
                     max_selectors: int = suggest.MAX_SELECTORS) -> DiagnoseResult:
    """Diagnose captured elements.

    * ``style_payloads(by…, payload)`` alone: the capture script's reply
      already lists one result per requested selector, in request order —
      found ones with their computed styles, missing ones with the
      suggestions computed in the page; they are reported as they are.
    * ``requests(by…, pos, selector)`` with ``elements(by…, selector,
      styles)``: each request is looked up; a miss becomes a not-found row
      whose suggestions come from ``dom_tokens``.

    ``single(by…, is_single)`` marks captures asked with one selector string
    (answered as one element instead of a batch)."""
    keys = as_keys(by)
    plain_unions((requests if requests is not None else style_payloads).sparkSession)
    if not keys:  # one global group
        tables = [df if df is None else df.withColumn(_ALL, F.lit(0)) for df in (requests, style_payloads, elements, dom_tokens)]
        r = diagnose_element(*tables, include_box_model, single if single is None else single.withColumn(_ALL, F.lit(0)),
                             [_ALL], write_intermediate, max_selectors)
        return DiagnoseResult(*[df.drop(_ALL) for df in (r.elements, r.batch, r.report, r.quarantine, r.rejected)])
    keep = materialize if write_intermediate else (lambda df, _name: df)
    first = requests if requests is not None else style_payloads
    quarantine = first.select(*keys, F.lit("element").alias("source"), F.lit("").alias("warning"), F.lit("").alias("raw")).limit(0)
    if style_payloads is not None:
        parsed = keep(payloads.parse_element_payloads(style_payloads, keys), "style_payloads")
        quarantine = payloads.quarantine(parsed, keys, "element")
        rows = payloads.element_rows(parsed, keys)
        if requests is None:
            report = audit.element_report(rows, include_box_model)
            ok = where_computed(parsed, F.col("payload_kind") != "failed").select(*keys, F.size("results").alias("_n"))
            if single is not None:  # a reply without the one element asked for can't be answered
                ok = ok.join(single.select(*keys, "is_single"), keys, "left")
                empty = F.coalesce(F.col("is_single"), F.lit(False)) & (F.col("_n") == 0)
                lost = ok.where(empty).select(*keys).join(style_payloads.select(*keys, F.col("payload").alias("raw")), keys)
                quarantine = quarantine.unionByName(lost.select(
                    *keys, F.lit("element").alias("source"),
                    F.lit(payloads.STYLE_WARNING + payloads.NO_ELEMENT).alias("warning"), "raw"))
                ok = ok.where(~empty)
            batch = audit.batch_report(report, keys, captures=ok.select(*keys))
            return _diagnosis(report, batch, keys, single, keep(quarantine, "quarantine"))
        elements = rows.where(~F.col("not_found")).select(*keys, "selector", "styles")
    # a request asks for at most so many selectors; a larger one is rejected whole
    over = suggest.check_batch_size(requests, keys, max_selectors).select(*keys)
    rejected = requests.join(over, keys, "left_semi").select(*keys, "pos", "selector")
    # the warning quotes as many selectors as show the breach; ``rejected`` has all as rows
    quoted = top_k(rejected, keys, [F.col("pos"), F.col("selector")], max_selectors + 1, "_no")
    quarantine = quarantine.unionByName(quoted.groupBy(*keys).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_no", "selector"))), lambda x: x["selector"])).alias("raw"))
        .select(*keys, F.lit("element").alias("source"), F.lit(payloads.STYLE_WARNING + payloads.TOO_MANY).alias("warning"), "raw"))
    requests = requests.join(over, keys, "left_anti")
    report, batch = reports.diagnose(requests, elements, dom_tokens, include_box_model, keys)
    return _diagnosis(report, batch, keys, single, keep(quarantine, "quarantine"), rejected)


def _diagnosis(report: DataFrame, batch: DataFrame, keys, single, quarantine: DataFrame,
               rejected: DataFrame | None = None) -> DiagnoseResult:
    docs = sinks.diagnose_json(report, batch, keys, single).unionByName(sinks.warning_json(quarantine, keys))
    if rejected is None:
        rejected = report.select(*keys, "pos", "selector").limit(0)
    return DiagnoseResult(report, batch, docs, quarantine, rejected)
