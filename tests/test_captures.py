"""Dumps of captures, as a batch and as a stream."""

import gzip
import json
import os

from webdiag.operators import rollup
from webdiag.sources import captures as CP
from webdiag.sources import payloads as PL

LOG = [{"level": "error", "text": "boom"}, {"level": "info", "text": "täg \"x\"\n"}]


def _lines():
    return [json.dumps({"capture_id": "text", "payload": json.dumps(LOG)}),
            json.dumps({"payload": LOG, "more": 1, "capture_id": "value"}),
            json.dumps({"capture_id": "none"}), json.dumps({"capture_id": None, "payload": "[]"}),
            "{\"capture_id\": \"cut", "", "not json",
            json.dumps({"capture_id": "text", "payload": json.dumps(LOG)})]


def _dump(folder, name, lines, opener=open):
    os.makedirs(folder, exist_ok=True)
    with opener(os.path.join(folder, name), "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_batch_keeps_every_line(spark, tmp_path):
    _dump(tmp_path / "in", "a.json", _lines())
    got = CP.read_captures(spark, str(tmp_path / "in"))
    rows = got.collect()
    assert len(rows) == 7  # the empty line is no row
    assert sorted(str(r.capture_id) for r in rows if r.corrupt is None) == ["None", "none", "text", "text", "value"]
    assert all(r.file.endswith("a.json") and r.block_start == 0 and r.block_bytes > 0 for r in rows)
    bad = CP.corrupt(got, "console").collect()
    assert sorted(r.raw for r in bad) == ["not json", "{\"capture_id\": \"cut"]
    assert {r.source for r in bad} == {"console"}
    payloads = {r.capture_id: r.payload for r in CP.sound(got).collect()}
    assert json.loads(payloads["value"]) == LOG == json.loads(payloads["text"])
    assert payloads["none"] is None


def test_reads_as_the_payloads_do(spark, tmp_path):
    _dump(tmp_path / "in", "a.json.gz", _lines(), gzip.open)
    e = rollup.normalize(PL.console_entries(PL.parse_console_payloads(CP.sound(CP.read_captures(spark, str(tmp_path / "in"))))))
    got = sorted((r.capture_id, r.message) for r in e.where("capture_id is not null").collect())
    assert got == sorted([("text", x["text"]) for x in LOG] * 2 + [("value", x["text"]) for x in LOG])


def test_files_are_split_and_long_replies_are_whole(spark, tmp_path):
    long = "x" * 21_000_000  # beyond the JSON reader's own limit
    _dump(tmp_path / "in", "a.json", [json.dumps({"capture_id": str(k), "payload": "y" * 1000}) for k in range(2000)]
          + [json.dumps({"capture_id": "long", "payload": long})])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        got = CP.read_captures(spark, str(tmp_path / "in"))
        assert got.rdd.getNumPartitions() > 10 and got.select("block_start").distinct().count() > 1
        assert got.selectExpr("count(distinct capture_id) n", "max(length(payload)) m").first() == (2001, len(long))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_typed_keys_and_empty_folder(spark, tmp_path):
    _dump(tmp_path / "in", "a.json", [json.dumps({"day": "2024-05-01", "site": 7, "payload": "[]"}),
                                      json.dumps({"day": "soon", "site": 8, "payload": "[]"})])
    got = CP.read_captures(spark, str(tmp_path / "in"), by=["day date", "site long"]).orderBy("site").collect()
    assert str(got[0].day) == "2024-05-01" and got[0].corrupt is None
    assert got[1].payload is None and "soon" in got[1].corrupt
    os.makedirs(tmp_path / "empty")
    assert CP.read_captures(spark, str(tmp_path / "empty")).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))

    def run():
        q = (CP.stream_captures(spark, src, max_bytes=1 << 20).writeStream.format("parquet").option("checkpointLocation", ckpt)
             .option("path", out).trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out)
    _dump(src, "a.json", _lines())
    assert run().count() == 7
    _dump(src, "b.json", [json.dumps({"capture_id": "b", "payload": "[]"})])
    assert run().count() == 8  # a.json is not read again
    assert run().count() == 8
    assert CP.corrupt(spark.read.parquet(out), "console").count() == 2
