"""The archive: exact round trip, one copy of each payload, damage is found."""

import hashlib

import pytest

from gridwright.llm import store, warc_store
from pyspark.sql import functions as F

BIG = "<html>" + "é" * 600 + "</html>"
ROWS = [(1, "http://a/", BIG, 0), (2, "http://b/", BIG, 0), (3, None, BIG, 0), (3, None, BIG, 0), (4, "http://c/\r\nx", "small", 0), (5, "u", "small", 0),
        (6, "u", None, 0), (7, "u", "", 0), (None, "n", BIG, 0), (8, "w", "x" * 200_000, 0)]
SCHEMA = "page_id long, url string, html string, address int"


def parse(record):
    head, block = record.split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    assert first == "WARC/1.1" and block.endswith(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in lines), block[:-4]


def test_round_trip(spark, frame):
    read = warc_store.archived(frame(ROWS, SCHEMA))
    rows = read.withColumn("record", warc_store.record_bytes(F.col("header"), F.col("record_type"), F.col("payload"))).collect()
    want = {}
    for page, _, html, _ in ROWS:
        body = (html or "").encode()
        revisit = len(body) >= 1000 and html == BIG and page != 3
        want.setdefault((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None), []).append(body)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == \
        sorted((k for k, v in want.items() for _ in v), key=str)
    for r in rows:
        head, block = parse(bytes(r.record))
        assert int(head["Content-Length"]) == len(block) and head["WARC-Type"] == r.record_type
        assert block == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert head.get("WARC-Target-URI") == {4: "http://c/%0D%0Ax", 3: None}.get(r.id, head.get("WARC-Target-URI"))


def test_payloads_are_stored_once_and_damage_is_found(spark, frame):
    folder = store.shared_path(spark, "archive")
    warc_store.write_archive(frame(ROWS, SCHEMA), folder)
    kept = spark.read.parquet(f"{folder}/payloads")
    assert kept.count() == 4
    other = store.shared_path(spark, "archive")
    kept.withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit(b"smell")).otherwise(F.col("payload"))).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{other}/records")
    with pytest.raises(Exception, match="archive damaged"):
        warc_store.read_archive(spark, other).collect()


def test_empty_table(frame):
    assert warc_store.archived(frame([], SCHEMA)).count() == 0
