import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from matgraph.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("chunk", [7, 1000, warc.CHUNK])
def test_round_trip(spark, chunk):
    rows = [(1, "http://a/ b\r\nX: y", "same é"), (5, None, "same é"), (3, "http://c", "same é"), (2, "u", None), (9, "u", ""), (4, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (6, "u", "x" * 5001), (7, "u", "y" * 14)]
    path, got = warc.archive(rows_of(spark, rows), chunk=chunk)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", 0), i)
    want = {i: (len((h or "").encode()), b32(h), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, _, h in rows}
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    chunks = warc.chunk_table(spark, path).collect()
    assert all(len(r["data"] or b"") <= chunk for r in chunks)
    assert sum(r["page_id"] == 6 for r in chunks) == -(-5001 // chunk)


def test_odd_rows(spark):
    rows = [(None, "u", "a"), (None, "u", "b" * 50), (3, "u", "a"), (8, "u", "c" * 50), (8, "u", "c" * 50), (8, "u", "d" * 50)]
    got = warc.archive(rows_of(spark, rows), chunk=20)[1].collect()
    assert len(got) == 6 and {r["record_type"] for r in got} == {"response"} and sorted(r["payload_bytes"] for r in got) == [1, 1, 50, 50, 50, 50]
    assert warc.archive(rows_of(spark, []))[1].collect() == []
    assert {r["record_type"] for r in warc.archive(rows_of(spark, [(1, "u", "a"), (2, "u", "a")]), min_bytes=2)[1].collect()} == {"response"}


def test_files_are_plain_gzip_archives(spark):
    import glob

    path, _ = warc.archive(rows_of(spark, [(i, "http://x", f"page {i}" * 50) for i in range(20)]), chunk=100)
    text = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/part-*"))
    assert text.count(b"WARC-Type: response\r\n") == 20 and text.count(b"WARC-Type: continuation\r\n") > 20


def test_splits_and_damage(spark):
    pages = rows_of(spark, [(i, "http://x", "".join(chr(33 + (i * k * k) % 90) for k in range(3000))) for i in range(300)]).coalesce(1)
    path, _ = warc.archive(pages, chunk=700)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        again = warc.read(spark, path)
        assert again.count() == 300 and again.selectExpr("sum(payload_bytes)").first()[0] == 900_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (record,) = warc.records(1, "u", memoryview(b"abc"), None, False, b32("abc"))
    assert warc.parse(warc._member(record))["payload_digest"] == b32("abc")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(warc._member(record.replace(b"abc", b"abd")))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(1, "u", memoryview(b"abc"), None, False, b32("x")))


def test_separator_in_a_payload():
    body = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(9)) + warc.SEPARATOR
    (record,) = warc.records(1, "u", memoryview(body), None, False, base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert warc.SEPARATOR not in warc._member(record) and warc.parse(warc._member(record))["sha1"] == hashlib.sha1(body).digest()


def test_a_huge_payload_is_never_copied_as_a_whole():
    import tracemalloc

    payload = bytes(range(256)) * (100 << 12)  # 100 MB
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    tracemalloc.start()
    n = sum(1 for _ in warc.records(1, "u", memoryview(payload), None, False, digest))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == len(payload) // warc.CHUNK and peak < 8 * warc.CHUNK
    table = [{"page_id": 1, "record_type": "response" if k == 1 else None, "refers_to": None, "payload_bytes": len(payload) if k == 1 else None, "payload_digest": digest if k == 1 else None,
              "record": "r", "segment": k, "data": payload[(k - 1) << 16 : k << 16]} for k in range(1, 33)]
    table[0]["payload_bytes"], table[0]["payload_digest"] = 32 << 16, base64.b32encode(hashlib.sha1(payload[: 32 << 16]).digest()).decode()
    batches = [pa.RecordBatch.from_pylist([row]) for row in table]
    (found,) = [r for b in warc._digested(batches) for r in b.to_pylist()]
    assert found["payload_bytes"] == 32 << 16


def test_dates(spark):
    path, _ = warc.archive(rows_of(spark, [(1, "u", "a")]))
    (row,) = warc.chunk_table(spark, path).collect()
    assert row["page_id"] == 1
    (record,) = warc.records(1, "u", memoryview(b"abc"), None, False, b32("abc"), date="2024-02-03T04:05:06Z")
    assert b"WARC-Date: 2024-02-03T04:05:06Z\r\n" in record
