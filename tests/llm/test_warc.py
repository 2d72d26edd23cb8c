import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from codecorpus.llm import warc
from codecorpus.llm.common import cut, shared_path

PAGES = "page_id long, url string, html string"
ROWS = [(1, "https://a/", "<p>same</p>"), (2, "https://b/\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 40),
        (6, "u", "äß漢\U0001f600" * 500), (None, "n", "no id"), (7, "r", "<p>same</p>"), (7, "r", "<p>same</p>"), (8, "z", "0\r\n\r\n")]


def archive(spark, pages, **options):
    path = shared_path(spark, "test-warc")
    warc.write(pages, path, **options)
    return path


@pytest.mark.parametrize("sizes", [{}, {"segment_chars": 97, "chunk_chars": 13}])
def test_round_trip(spark, sizes):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({c: F.lit("x") for c in ("pid", "payload", "nth", "segment")})
    path = archive(spark, pages, **sizes)
    whole = warc.reassemble(warc.read_records(spark, path)).collect()
    assert len(whole) == len(ROWS) and all(r.status == "ok" for r in whole)
    payloads = {(r.page_id, r.payload) for r in whole if r.record_type == "response"}
    assert payloads == {(i, (h or "").encode()) for i, _, h in ROWS if i not in (1, 2, 3)}
    index = warc.page_index(warc.reassemble(warc.read_records(spark, path))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in index if r.page_id in (1, 2, 3, 4, 7)) == [
        (1, "revisit", 7), (2, "revisit", 7), (3, "revisit", 4), (4, "response", None), (7, "response", None), (7, "revisit", 7)]
    html = {i: (h or "").encode() for i, _, h in ROWS}
    for r in index:
        assert r.status == "ok" and r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()


def test_least_bytes(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    path = archive(spark, spark.createDataFrame(rows, PAGES), least_bytes=4)
    index = warc.page_index(warc.reassemble(warc.read_records(spark, path))).collect()
    assert sorted((r.page_id, r.record_type) for r in index) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_missing_and_wrong_segments(spark):
    path = archive(spark, spark.createDataFrame([(1, "u", "x" * 500), (2, "u", "y" * 500)], PAGES), segment_chars=100)
    parsed = cut(warc.read_records(spark, path))
    lost = warc.reassemble(parsed.where("NOT (segment = 3 AND part LIKE '%x%')")).collect()
    assert {r.page_id: (r.status, r.payload is None) for r in lost} == {1: ("incomplete", True), 2: ("ok", False)}
    short = warc.reassemble(parsed.withColumn("total", F.col("total") - 1)).collect()
    assert {r.status for r in short} == {"incomplete"}


def test_files_are_warc(spark):
    path = archive(spark, spark.createDataFrame(ROWS, PAGES), segment_chars=200)
    files = spark.read.format("binaryFile").load(path).collect()
    records = [(h, b) for f in files if f.length for h, b in warc.parse(gzip.decompress(bytes(f.content)))]
    assert len({h["warc-record-id"] for h, _ in records}) == len(records)
    assert {h["warc-type"] for h, _ in records} == {"response", "revisit", "continuation"}
    for h, block in records:
        assert int(h["content-length"]) == len(block) and "\n" not in h.get("warc-target-uri", "")
        if h["warc-type"] == "continuation":
            assert int(h["warc-segment-number"]) > 1 and h["warc-segment-origin-id"]


def test_empty_table(spark):
    path = archive(spark, spark.createDataFrame([], PAGES))
    assert warc.page_index(warc.reassemble(warc.read_records(spark, path))).count() == 0
