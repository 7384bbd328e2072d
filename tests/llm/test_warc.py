import base64
import hashlib

import pytest

from webdiag.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (9, "http://c/\r\nX: y", "same"),
            (7, None, None), (8, "http://e/", ""), (None, "http://f/", "alone"), (None, "http://g/", "same"), (1, "u", "é" * 70_000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages, tmp_path):
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    stored = spark.read.parquet(f"{folder}/payloads")
    assert sorted(bytes(r.payload) for r in stored.collect()) == sorted({(r.html or "").encode() for r in pages.collect()})
    index = warc.read_index(spark, folder).collect()
    assert len(index) == 9 and all(r.verified for r in index)
    for r in index:
        if r.record_type == "response":
            assert r.refers_to is None
    same = [r for r in index if r.payload_bytes == 4]
    assert sorted(str(r.page_id) for r in same) == ["2", "2", "5", "9", "None"]
    assert sum(r.record_type == "response" for r in same) == 1
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {"2"}
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert {r.payload_digest for r in same} == {digest}
    records = warc.read_records(spark, folder).collect()
    for r in records:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert len(body) - 4 == int(fields[b"Content-Length"])
        assert body[:-4] == (bytes(r.payload) if fields[b"WARC-Type"] == b"response" else b"")
        assert b"X" not in fields
    html = {(r.page_id, r.url or ""): (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == html[r.page_id, r.url] for r in records)


def test_without_broadcast(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4


def test_least_size_and_empty_table(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path / "a"), min_bytes=5)
    assert all(r.record_type == "response" for r in warc.read_index(spark, str(tmp_path / "a")).collect())
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_index(spark, str(tmp_path / "b")).count() == 0
