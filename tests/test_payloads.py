"""Payload shapes → entries / elements / quarantine (untested in the reference)."""

import json

from pyspark.sql import functions as F

from webdiag.sources import payloads as P


def parse(spark, rows, fn):
    return fn(spark.createDataFrame(rows, "capture_id string, payload string"))


def test_console_shapes(spark):
    fence = json.dumps({"content": [{"text": "```json\n[{\"level\":\"error\",\"text\":\"boom\"}]\n```"}]})
    rows = [("a", json.dumps([{"level": "error", "text": "x"}, {"type": "warn", "message": "y"}])),
            ("b", json.dumps({"result": [{"text": "r"}]})), ("c", json.dumps({"logs": [{"text": "l"}]})),
            ("d", json.dumps({"messages": [{"text": "m"}]})),
            ("e", json.dumps({"content": [{"text": "No console messages found on this page"}]})),
            ("f", json.dumps({"content": [{"text": "Intro\n## Console\nnothing"}]})),
            ("g", fence), ("h", json.dumps({"content": [{"text": "{\"logs\": [{\"text\": \"t\"}]}"}]})),
            ("i", "not json"), ("j", json.dumps({"result": "not an array"})),
            ("k", json.dumps({"content": [{"text": "```json {broken ```"}]}))]
    parsed = parse(spark, rows, P.parse_console_payloads)
    kinds = {r.capture_id: r.payload_kind for r in parsed.collect()}
    assert kinds == {"a": "array", "b": "result", "c": "logs", "d": "messages", "e": "markdown", "f": "markdown",
                     "g": "text", "h": "text", "i": "failed", "j": "failed", "k": "failed"}
    entries = P.console_entries(parsed).orderBy("capture_id", "seq").collect()
    assert [(e.capture_id, e.seq) for e in entries] == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0), ("g", 0),
                                                        ("h", 0)]
    assert entries[1].type == "warn" and entries[1].message == "y" and entries[5].text == "boom"
    q = {r.capture_id: r.warning for r in P.quarantine(parsed).collect()}
    assert q["i"] == "Log extraction failed: Unrecognized console log response shape: not json"
    assert q["k"] == "Log extraction failed: invalid JSON in text payload"
    assert set(q) == {"i", "j", "k"}


def test_element_shapes(spark):
    rows = [("a", json.dumps({"results": [{"selector": "#x", "styles": {"display": "none"}},
                                          {"selector": "#y", "notFound": True, "suggestions": ["#yy"]}]})),
            ("b", json.dumps({"result": {"results": [{"selector": ".z", "styles": {}}]}})),
            ("c", json.dumps({"content": [{"text": "```json {\"results\":[{\"selector\":\"#t\"}]} ```"}]})),
            ("d", json.dumps({"content": [{"text": "null"}]})), ("e", json.dumps({"results": "oops"})),
            ("f", "<html>")]
    parsed = parse(spark, rows, P.parse_element_payloads)
    els = P.element_rows(parsed).orderBy("capture_id", "pos").collect()
    assert [(e.capture_id, e.selector, e.not_found) for e in els] == [
        ("a", "#x", False), ("a", "#y", True), ("b", ".z", False), ("c", "#t", False)]
    assert els[0].styles == {"display": "none"} and els[3].styles == {}
    q = {r.capture_id: r.warning for r in P.quarantine(parsed, source="element").collect()}
    assert q == {"d": "Style extraction failed: Script returned null",
                 "f": "Style extraction failed: Unrecognized response shape: <html>"}


def test_variant_stacks_compress(spark):
    from webdiag.operators import stacks
    rows = [("a", json.dumps([{"level": "error", "text": "x",
                               "stackTrace": ["at f (https://h/a.js:1:2)", {"functionName": "g", "url": "https://h/b.js",
                                                                            "lineNumber": 3, "columnNumber": 4}]}])),
            ("b", json.dumps([{"level": "error", "text": "x", "stack": "at q (https://h/c.js:5:6)\nnext"}]))]
    e = P.console_entries(parse(spark, rows, P.parse_console_payloads))
    out = {r.capture_id: r.stack_trace for r in stacks.compress_stacks(e).collect()}
    assert out["a"] == ["at f (https://h/a.js:1:2)", "at g (https://h/b.js:3:4)"]
    assert out["b"] == ["at q (https://h/c.js:5:6)", "next"]


def test_whole_payload_is_kept(spark):
    from webdiag import api
    bad = "not json " + "x" * 1000
    odd = json.dumps({"weird": "y" * 500})
    p = spark.createDataFrame([("a", bad), ("b", odd), ("c", '[{"level":"error","text":"t"}, null]')], "capture_id string, payload string")
    r = api.get_errors(p, severity="all", resolve_sourcemaps=False)
    q = {x.capture_id: x for x in r.quarantine.collect()}
    assert q["a"].raw == bad and q["b"].raw == odd and set(q) == {"a", "b", "c"}
    assert len(q["b"].warning) == len("Log extraction failed: Unrecognized console log response shape: ") + 200
    docs = {x.capture_id: json.loads(x.report) for x in r.report.collect()}
    assert docs["a"]["raw"] == bad and docs["b"]["raw"] == {"weird": "y" * 500}
    assert docs["c"]["_warning"].endswith("null entry in the log")


def test_duplicate_keys_and_long_strings(spark):
    from webdiag import api
    entries = json.dumps([{"level": "error", "text": "boom " + "z" * 3_000_000} for _ in range(9)])
    rows = [("dup", '[{"level":"log","level":"error","text":"a","text":"b"}]'),
            ("long", json.dumps({"content": [{"text": "```json " + entries + " ```"}]})),
            ("direct", '{"messages":' + entries + "}")]
    assert len(rows[1][1]) > 25_000_000
    p = spark.createDataFrame(rows, "capture_id string, payload string")
    r = api.get_errors(p, severity="error", resolve_sourcemaps=False)
    got = {(x.capture_id, x["count"], x.message[:5]) for x in r.issues.collect()}
    assert got == {("dup", 1, "b"), ("long", 9, "boom "), ("direct", 9, "boom ")}
    assert r.quarantine.count() == 0


def test_replies_without_elements(spark):
    from webdiag import api
    p = spark.createDataFrame([("batch", '{"results":[]}'), ("one", '{"results":[]}'), ("text", '{"results":"x"}')],
                              "capture_id string, payload string")
    single = spark.createDataFrame([("one", True)], "capture_id string, is_single boolean")
    r = api.diagnose_element(style_payloads=p, single=single)
    assert {x.capture_id: x.summary for x in r.batch.collect()} == {
        k: "0 element diagnosed, 0 with issues." for k in ("batch", "text")}
    docs = {x.capture_id: json.loads(x.report) for x in r.report.collect()}
    assert docs["batch"] == {"summary": "0 element diagnosed, 0 with issues.", "details": {"results": []}}
    assert docs["one"]["_warning"] == "Style extraction failed: no element in the reply" and docs["one"]["raw"] == {"results": []}


def test_one_global_group(spark):
    from webdiag import api
    p = spark.createDataFrame([('[{"level":"error","text":"a"}]',), ('{"logs":[{"level":"error","text":"a"}]}',)], "payload string")
    r = api.get_errors(p, resolve_sourcemaps=False, by=[])
    assert [(x["count"], x.message) for x in r.issues.collect()] == [(2, "a")] and "_all" not in r.report.columns
    e = spark.createDataFrame([('{"results":[{"selector":"#a","styles":{"opacity":"0"}}]}',)], "payload string")
    assert api.diagnose_element(style_payloads=e, by=[]).batch.collect()[0].n_with_issues == 1


def test_empty_stack_in_a_payload(spark):
    from webdiag import api
    p = spark.createDataFrame([("a", '[{"level":"error","text":"x","stack":""},{"level":"error","text":"y","stack":[]}]')],
                              "capture_id string, payload string")
    got = {x.message: x.stack_trace for x in api.get_errors(p).issues.collect()}
    assert got == {"x": None, "y": []}


def test_reports_of_many_captures_keep_their_partitions(spark):
    """Rows much alike take few bytes, by which Spark would put all captures into one task or broadcast them."""
    from webdiag.operators import reports
    payloads = spark.range(60).select(F.col("id").cast("string").alias("capture_id"), F.lit(
        '[{"level":"error","text":"x 1","source":"b"},{"level":"error","text":"x 1"},{"text":"y","stack":"at f (a.js:1:2)"}]').alias("payload"))
    parsed = P.parse_console_payloads(payloads)
    issues, summary = reports.error_report(P.console_entries(parsed), "all", 20, captures=parsed.select("capture_id"))
    assert summary.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "BroadcastHashJoin" not in summary._jdf.queryExecution().executedPlan().toString()
    assert {(r["total_log_entries"], r["unique_issues"], r["summary"]) for r in summary.collect()} == {
        (3, 2, "2 unique issues (from 3 total log entries). Top: x 1")}
    got = issues.where("capture_id = '7'").orderBy("issue_no").select("issue_no", "message", "count", "source", "first_seq", "stack_trace")
    assert [tuple(r) for r in got.collect()] == [(1, "x 1", 2, "b", 0, None), (2, "y", 1, None, 2, ["at f (a.js:1:2)"])]
