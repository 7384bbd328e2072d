"""python -m webdiag on small inputs."""

import json

from fixtures import N_ENTRIES
from test_api import noisy_payload
from webdiag.__main__ import main


def test_get_errors_cli(spark, tmp_path):
    src = str(tmp_path / "payloads.jsonl")
    with open(src, "w") as f:
        f.write(json.dumps({"capture_id": "page", "payload": noisy_payload()}) + "\n")
    out = str(tmp_path / "out")
    main(["get-errors", "--payloads", src, "--out", out, "--severity", "error"], spark=spark)
    s = spark.read.parquet(f"{out}/summary").collect()
    assert s[0].unique_issues == 3 and s[0].total_log_entries == N_ENTRIES
    doc = json.loads(spark.read.text(f"{out}/reports").collect()[0].value)
    assert doc["summary"].startswith("3 unique issues")


def test_diagnose_cli(spark, tmp_path):
    src = str(tmp_path / "styles.jsonl")
    reply = {"results": [{"selector": "#a", "styles": {"display": "none"}}]}
    with open(src, "w") as f:
        f.write(json.dumps({"capture_id": "c", "payload": json.dumps(reply)}) + "\n")
    out = str(tmp_path / "out")
    main(["diagnose-element", "--payloads", src, "--out", out], spark=spark)
    b = spark.read.parquet(f"{out}/batch").collect()[0]
    assert b.summary == "1 element diagnosed, 1 with issues. Top: #a display:none."


def test_diagnose_requests(spark, tmp_path):
    import json

    from webdiag.__main__ import main
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    table([("c", 0, "#a"), ("c", 1, "#zz"), ("s", 0, "#a")], "capture_id string, pos int, selector string", "requests")
    table([("c", "#a", {"display": "none"}), ("s", "#a", {"opacity": "1"})],
          "capture_id string, selector string, styles map<string,string>", "elements")
    table([("c", "id", "zz-top", 1)], "capture_id string, kind string, token string, doc_order int", "tokens")
    table([("s", True)], "capture_id string, is_single boolean", "single")
    at = lambda name: str(tmp_path / name)
    main(["diagnose-element", "--requests", at("requests"), "--elements", at("elements"), "--dom-tokens", at("tokens"),
          "--single", at("single"), "--out", at("out")], spark)
    rows = {(r.capture_id, r.selector): r for r in spark.read.parquet(at("out/elements")).collect()}
    assert rows["c", "#a"].issues[0].property == "display" and rows["c", "#a"].top.severity == "high"
    assert rows["c", "#zz"].suggestions == ["#zz-top"]
    docs = [json.loads(r.value) for r in spark.read.text(at("out/reports")).collect()]
    assert sorted("results" in d["details"] for d in docs) == [False, True]
