"""JSON envelopes."""

import json

from pyspark.sql import functions as F

from fixtures import N_ENTRIES, noisy_entries
from webdiag.operators import reports
from webdiag.sources import sinks


def test_error_report_json(spark):
    issues, summary = reports.error_report(noisy_entries(spark), severity="error", limit=20)
    doc = json.loads(sinks.error_report_json(issues, summary).collect()[0].report)
    assert doc["summary"].startswith(f"3 unique issues (from {N_ENTRIES} total log entries).")
    d = doc["details"]
    assert d["total_log_entries"] == N_ENTRIES
    assert [(i["level"], i["count"], i["source"], i["stackTrace"]) for i in d["unique_issues"]] == [
        ("error", 5, "shelf.mjs", None), ("error", 2, "https://seeds.example.org/prices", None),
        ("error", 1, "map.mjs", None)]


def test_diagnose_json_single_and_batch(spark):
    req = spark.createDataFrame([("b", 0, "#main"), ("b", 1, "#nope"), ("s", 0, "#main")],
                                "capture_id string, pos int, selector string")
    els = spark.createDataFrame([("b", "#main", {"display": "none", "-webkit-x": "1"}),
                                 ("s", "#main", {"opacity": "1"})],
                                "capture_id string, selector string, styles map<string,string>")
    report, batch = reports.diagnose(req, els)
    single = spark.createDataFrame([("s", True)], "capture_id string, is_single boolean")
    docs = {r.capture_id: json.loads(r.report) for r in sinks.diagnose_json(report, batch, single=single).collect()}
    b = docs["b"]
    assert b["summary"] == "2 elements diagnosed, 1 with issues, 1 not found. Top: #main display:none."
    assert b["details"]["results"][0] == {"selector": "#main", "styles": {"display": "none"},
                                          "issues": [{"type": "hidden", "property": "display", "value": "none",
                                                      "severity": "high"}]}
    assert b["details"]["results"][1] == {"selector": "#nope", "not_found": True, "suggestions": []}
    s = docs["s"]
    assert s["summary"] == "#main: No obvious visual issues detected. display:?, opacity:1, visibility:?."
    assert s["details"] == {"selector": "#main", "issues": [], "styles": {"opacity": "1"}}


def test_more_than_twenty_selectors_are_rejected(spark):
    from webdiag import api
    req = spark.createDataFrame([("big", i, f"#e{i}") for i in range(21)] + [("ok", i, f"#e{i}") for i in range(20)],
                                "capture_id string, pos int, selector string")
    els = spark.createDataFrame([(c, f"#e{i}", {"opacity": "1"}) for i in range(21) for c in ("big", "ok")],
                                "capture_id string, selector string, styles map<string,string>")
    r = api.diagnose_element(req, elements=els)
    docs = {x.capture_id: json.loads(x.report) for x in r.report.collect()}
    assert len(docs["ok"]["details"]["results"]) == 20
    assert docs["ok"]["summary"] == "20 elements diagnosed, 0 with issues."
    assert docs["big"]["_warning"] == "Style extraction failed: too many selectors in one request"
    assert docs["big"]["raw"] == [f"#e{i}" for i in range(21)]
    assert [x.capture_id for x in r.quarantine.collect()] == ["big"]


def test_error_report_with_source_maps(spark):
    from test_frames import BUNDLE, FIXTURE_MAP
    from webdiag.operators import sourcemaps
    e = spark.createDataFrame([
        ("c", 0, "error", "TypeError: oops", [("z", BUNDLE, 1, 0), ("y", "https://h/src/a.js", 4, 2)]),
        ("c", 1, "error", "TypeError: oops", None),
        ("c", 2, "error", "Other", [])],
        "capture_id string, seq bigint, level string, text string, "
        "stack array<struct<functionName:string,url:string,lineNumber:bigint,columnNumber:bigint>>")
    segs = sourcemaps.build_segments(spark.createDataFrame([(BUNDLE, FIXTURE_MAP)], "url string, map_json string"))
    issues, summary = reports.error_report(e, severity="error", limit=20, segments=segs)
    got = {r.message: (r["count"], r.stack_trace, r.resolved_count) for r in issues.collect()}
    assert got["TypeError: oops"] == (2, ["at z (src/ProductList.jsx:1:0)", "at y (https://h/src/a.js:4:2)"], 1)
    assert got["Other"] == (1, [], 0)  # a resolver gives [] for an empty stack
    doc = json.loads(sinks.error_report_json(issues, summary).collect()[0].report)
    assert doc["details"]["_sourcemap_resolved"] == 1
    assert doc["details"]["unique_issues"][1]["stackTrace"] == []


def test_error_report_parameter_contract(spark):
    import pytest
    for sev, lim in (("fatal", 20), ("error", 0), ("error", 101)):
        with pytest.raises(ValueError):
            reports.error_report(noisy_entries(spark), severity=sev, limit=lim)
