"""The two operations end to end from payload text."""

import json

from fixtures import N_ENTRIES, SHOP_LOG, STOCK_ERROR
from webdiag import api


def noisy_payload():
    return json.dumps([{"level": lvl, "text": txt, "source": src, **({"url": url} if url else {})}
                       for lvl, txt, src, url in SHOP_LOG])


def test_get_errors_from_payload(spark):
    p = spark.createDataFrame([("page", noisy_payload()), ("empty", '{"content":[{"text":"No console messages"}]}'),
                               ("bad", "<html>")], "capture_id string, payload string")
    r = api.get_errors(p, severity="error", limit=20)
    s = {x.capture_id: x.summary for x in r.summary.collect()}
    assert s["page"] == f"3 unique issues (from {N_ENTRIES} total log entries). Top: {STOCK_ERROR}"
    assert s["empty"] == "No error messages found in console."
    assert "bad" not in s and [q.capture_id for q in r.quarantine.collect()] == ["bad"]
    doc = json.loads([x.report for x in r.report.collect() if x.capture_id == "page"][0])
    assert doc["details"]["_sourcemap_resolved"] == 0
    assert [i["count"] for i in doc["details"]["unique_issues"]] == [5, 2, 1]
    r2 = api.get_errors(p, severity="all", limit=1, resolve_sourcemaps=False)
    doc2 = json.loads([x.report for x in r2.report.collect() if x.capture_id == "page"][0])
    assert "_sourcemap_resolved" not in doc2["details"] and len(doc2["details"]["unique_issues"]) == 1


def test_diagnose_element_from_payload(spark):
    reply = json.dumps({"results": [{"selector": "#a", "styles": {"opacity": "0", "color": "red"}},
                                    {"selector": "#b", "notFound": True, "suggestions": []}]})
    p = spark.createDataFrame([("c", reply)], "capture_id string, payload string")
    req = spark.createDataFrame([("c", 0, "#a"), ("c", 1, "#b")], "capture_id string, pos int, selector string")
    r = api.diagnose_element(req, style_payloads=p)
    doc = json.loads(r.report.collect()[0].report)
    assert doc["summary"] == "2 elements diagnosed, 1 with issues, 1 not found. Top: #a opacity:0."
    assert doc["details"]["results"][0]["styles"] == {"opacity": "0", "color": "red"}


def test_diagnose_element_payload_only_keeps_page_suggestions(spark):
    reply = json.dumps({"result": {"results": [
        {"selector": ".card", "styles": {"display": "flex", "overflow": "hidden"}},
        {"selector": "#gone", "notFound": True, "suggestions": ["#gone-1", "#gone2"]}]}})
    p = spark.createDataFrame([("c", reply)], "capture_id string, payload string")
    r = api.diagnose_element(style_payloads=p)
    by_sel = {x.selector: x.summary for x in r.elements.collect()}
    assert by_sel["#gone"] == "#gone: element not found. Closest matches: #gone-1, #gone2"
    assert by_sel[".card"] == ".card: overflow:hidden on a flex/grid container can clip children unexpectedly"
    doc = json.loads(r.report.collect()[0].report)
    assert doc["summary"] == "2 elements diagnosed, 1 with issues, 1 not found. Top: .card overflow:hidden."
    assert doc["details"]["results"][1] == {"selector": "#gone", "not_found": True, "suggestions": ["#gone-1", "#gone2"]}
