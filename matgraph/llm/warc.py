"""WARC archives as a chunked record table.

A payload becomes rows of (record id, segment number, bytes): the response record
and, beyond ``CHUNK`` bytes, WARC continuation records. The rows are made and
compressed one at a time by a generator that carries the payload's SHA-1 along, so
nothing is allocated beside a row and the payload that the source delivered.
Each record is a gzip member of its own, and an empty member separates two, which
is how Spark's text source and sink, that reach any file system and split large
files, can carry binary records: the separator is their line end. Reading gives
the chunk table back in any order; records of several segments are sorted by
segment and digested as a stream.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes`` bytes,
that with the largest id is the response and the others are revisits of it.

Defined results: a null payload is empty; a null url is ``about:blank``; a record
with a null id is always a response (and never revisited, unless all ids of its
payload are null); rows with equal ids and payloads are all responses, or all
revisits, and share a record id; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BATCHES, map_arrow, new_folder, options, staged

CHUNK = 64 << 10
#: An empty gzip member. Its time stamp differs from that of the records' members.
SEPARATOR = b"\x1f\x8b\x08\x00\xff\xff\xff\xff\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_TEXT = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key, digest: str) -> str:
    return f"<urn:x-record:{'null' if key is None else key}:{digest}>"


def _key(uri: str) -> int | None:
    found = uri.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def _member(record: bytes) -> bytes:
    """The record as a gzip member that doesn't hold the separator."""
    for level in (4, 9, 1, 0):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        out = c.compress(record) + c.flush()
        if SEPARATOR not in out:
            return out
    raise ValueError("a record holds the separator in every compression")


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _url(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "about:blank")


def records(key, url: str | None, payload: memoryview, refers_to, revisit: bool, digest: str, chunk: int = CHUNK, date: str = EPOCH) -> Iterator[bytes]:
    """The WARC records of one payload, in order."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _url(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        yield _record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))], _HTTP)
        return
    n = max(1, -(-len(payload) // chunk))
    running = hashlib.sha1()
    for k in range(n):
        part = payload[k * chunk : (k + 1) * chunk]
        running.update(part)
        so_far = [("X-Digest-So-Far", f"sha1:{base32(running.digest())}")] if n > 1 else []
        if n > 1 and k == n - 1:
            so_far.append(("WARC-Segment-Total-Length", len(_HTTP) + len(payload)))
        if k == 0:
            yield _record(fields + ([("WARC-Segment-Number", 1)] if n > 1 else []) + so_far, _HTTP + bytes(part))
        else:
            own = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"{record_id(key, digest)[:-1]}:{k + 1}>"),
                ("WARC-Date", date),
                ("WARC-Target-URI", _url(url)),
                ("WARC-Segment-Number", k + 1),
                ("WARC-Segment-Origin-ID", record_id(key, digest)),
            ]
            yield _record(own + so_far, bytes(part))
    if base32(running.digest()) != digest:
        raise ValueError(f"the payload of {record_id(key, digest)} has another digest than {digest}")


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK, date: str | None = None) -> None:
    """Archive every row under ``path``; ``date`` is that of the records, by default now.

    Which payloads are copies is settled on (id, digest, length) rows. Only groups of
    several go on to the payloads; Spark broadcasts them if they are small, and else
    joins by a shuffle, whose hot digests adaptive execution splits.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    keyed = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = keyed.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    copies = (
        keyed.filter(F.col("n") >= min_bytes)
        .groupBy("sha1", "n")
        .agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1 and response is not null")
        .drop("rows")
    )
    copies = staged(copies, "copies")
    revisit = F.coalesce(F.col("key") != F.col("response"), F.lit(False))
    rows = keyed.join(copies, ["sha1", "n"], "left").select("key", "url", "payload", "response", revisit.alias("revisit"), "sha1")

    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def members(batches):
        for batch in batches:
            out, size = [], 0
            for key, url, body, response, again, sha1 in zip(*(batch.column(i) for i in range(6))):
                view = memoryview(body.as_buffer())
                for r in records(key.as_py(), url.as_py(), view, response.as_py(), again.as_py(), base32(sha1.as_py()), chunk, date):
                    out.append(_member(r))
                    size += len(out[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    with options(pages.sparkSession, BATCHES):
        map_arrow(rows, members, "member binary").select(F.col("member").cast("string").alias("value")).write.options(**_TEXT).text(path)


SEGMENTS = "page_id long, record string, segment long, record_type string, refers_to long, payload_bytes long, payload_digest string, data binary, sha1 binary"


def parse(member: bytes) -> dict:
    """One row of the chunk table from a gzip member. A payload of one segment is
    digested at once and not handed on."""
    head, _, block = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    f = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(f["Content-Length"])]
    row = dict.fromkeys(("segment", "record_type", "refers_to", "payload_bytes", "payload_digest", "data", "sha1"))
    row["record"] = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
    row["page_id"] = _key(row["record"])
    row["segment"] = int(f.get("WARC-Segment-Number", 0))
    if f["WARC-Type"] == "continuation":
        return row | {"data": block}
    row |= {"record_type": f["WARC-Type"], "payload_bytes": int(f["X-Payload-Length"]), "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:")}
    if f["WARC-Type"] == "revisit":
        return row | {"refers_to": _key(f["WARC-Refers-To"])}
    body = block.partition(b"\r\n\r\n")[2]
    if row["segment"]:
        return row | {"data": body}
    row["sha1"] = hashlib.sha1(body).digest()
    if len(body) != row["payload_bytes"] or base32(row["sha1"]) != row["payload_digest"]:
        raise ValueError(f"record {row['page_id']} is damaged")
    return row


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The archives under ``path`` as rows of (page_id, segment, ...): segment 0 for
    records of one segment, else from 1, with their data."""

    def rows(batches):
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SEGMENTS.split(", ")])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [parse(m.as_py()) for m in batch.column(0).slice(at, 256) if len(m.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], schema.field(n).type) for n in names], schema=schema)

    lines = spark.read.options(**_TEXT).text(path).select(F.col("value").cast("binary").alias("member"))
    return map_arrow(lines, rows, SEGMENTS)


def _digested(batches):
    """Records of several segments, sorted by record and segment: one row for each,
    with a digest that grows segment by segment. Rows that were archived twice have
    each segment twice."""
    names = ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    head, running, size, last, times = None, hashlib.sha1(), 0, 0, 0
    out: list[tuple] = []

    def close() -> None:
        if head is not None:
            if size != head["payload_bytes"] or base32(running.digest()) != head["payload_digest"]:
                raise ValueError(f"record {head['record']} is damaged")
            out.extend([tuple(head[n] for n in names)] * times)

    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(n)[at].as_py() for n in (*names, "record", "segment")}
            if row["segment"] == 1 and (head is None or row["record"] != head["record"]):
                close()
                head, running, size, last, times = row, hashlib.sha1(), 0, 0, 0
            times += row["segment"] == 1
            if row["segment"] > last:
                data = batch.column("data")[at].as_buffer()
                running.update(data)
                size += len(data)
                last = row["segment"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=list(names))
        out.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=list(names))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each archived payload: page_id, payload_bytes, payload_digest,
    record_type, refers_to; digests of responses are computed from what was read."""
    chunks = staged(chunk_table(spark, path), "chunks")
    cols = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    whole = chunks.filter("segment = 0").select(*cols)
    parts = chunks.filter("segment > 0")
    parts = parts.repartition(F.col("record")).sortWithinPartitions("record", "segment")
    joined = map_arrow(parts.select(*cols, "record", "segment", "data"), _digested, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")
    return whole.unionByName(joined).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive(pages: DataFrame, *, min_bytes: int = 0, chunk: int = CHUNK) -> tuple[str, DataFrame]:
    """Write and read back: (folder, one row for each page)."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path, min_bytes=min_bytes, chunk=chunk)
    return path, read(spark, path)
