"""Downloads as rows: many URLs at once, by executors.

:func:`fetched` takes each URL whole. Large ones are planned as byte ranges (:func:`planned`) that
:func:`parts` downloads as rows of their own: by many tasks, each range retried alone, and from where
its connection broke off. :func:`digested` digests the parts in order, a part at a time.
"""

from __future__ import annotations

import hashlib
import http.client
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matgraph.operators.shipping import ship
from matgraph.sources.stock import BLOCK, tls_context

_SCHEMA = pa.schema([("url", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())])


def fetched(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, length, sha256, content) of each URL. The digest is taken from the stream. A
    task retries with its rows, so a lost executor costs its own downloads only."""

    def fetch(batches):
        for batch in batches:
            for url in batch.column(0).to_pylist():
                hasher, parts = hashlib.sha256(), []
                context = tls_context() if url.lower().startswith("https") else None
                with urllib.request.urlopen(url, context=context) as response:
                    while block := response.read(BLOCK):
                        hasher.update(block)
                        parts.append(block)
                content = b"".join(parts)
                yield pa.RecordBatch.from_pylist([{"url": url, "length": len(content), "sha256": hasher.hexdigest(), "content": content}], schema=_SCHEMA)

    ship(urls.sparkSession)
    given = urls.select(F.col(url_col).alias("url")).filter("url is not null")
    return given.mapInArrow(fetch, "url string, length long, sha256 string, content binary")


RANGE = "url string, part int, start long, stop long, tag string"
PART = "url string, part int, content binary, requests int"
#: What a connection may fail with that is worth another try.
_PASSING = (urllib.error.URLError, http.client.HTTPException, ConnectionError, TimeoutError)


def _response(url: str, headers: dict[str, str]):
    context = tls_context() if url.lower().startswith("https") else None
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), context=context, timeout=60)


def planned(urls: DataFrame, size: int = 8 << 20, url_col: str = "url") -> DataFrame:
    """RANGE rows: the byte ranges of about ``size`` that each URL is downloaded in, and the tag of its
    version. A server that gives no ranges gets one, with an unknown end."""

    def plan(batches):
        for batch in batches:
            for url in batch.column(0).to_pylist():
                with _response(url, {"Range": "bytes=0-0"}) as r:
                    total = r.headers.get("Content-Range", "").rpartition("/")[2]
                    tag = r.headers.get("ETag")
                    whole = r.status != 206 or not total.isdigit()
                if whole:
                    rows = [(url, 0, 0, None, None)]
                else:
                    rows = [(url, k, a, min(int(total), a + size), tag) for k, a in enumerate(range(0, max(1, int(total)), size))]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["url", "part", "start", "stop", "tag"])

    ship(urls.sparkSession)
    return urls.select(F.col(url_col).alias("url")).filter("url is not null").mapInArrow(plan, RANGE)


def parts(ranges: DataFrame, tries: int = 4) -> DataFrame:
    """PART rows: the content of each range, and the requests that it took. A range that breaks off goes
    on from the byte it had reached; a server whose file changed meanwhile is an error. Deal the
    ranges out (``ranges.repartition(n, "url", "part")``) for so many tasks."""

    def range_of(url: str, start: int, stop: int | None, tag: str | None) -> tuple[bytes, int]:
        held, requests = b"", 0
        while True:
            requests += 1
            try:
                headers = {} if stop is None else {"Range": f"bytes={start + len(held)}-{stop - 1}"} | ({"If-Range": tag} if tag else {})
                if stop is None:
                    held = b""
                with _response(url, headers) as r:
                    if stop is not None and r.status != 206:
                        raise ValueError(f"{url} changed while it was downloaded")
                    while block := r.read1(BLOCK):
                        held += block
                    missing = r.length if stop is None else stop - start - len(held)
                if not missing:
                    return held, requests
                raise http.client.IncompleteRead(b"", missing)
            except urllib.error.HTTPError as e:
                if e.code < 500 or requests >= tries:
                    raise
            except _PASSING:
                if requests >= tries:
                    raise

    def fetch(batches):
        for batch in batches:
            for url, part, start, stop, tag in zip(*(batch.column(i).to_pylist() for i in range(5))):
                content, requests = range_of(url, start, stop, tag) if stop is None or stop > start else (b"", 0)
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((url, part, content, requests), kinds)], names=["url", "part", "content", "requests"])

    ship(ranges.sparkSession)
    return ranges.select("url", "part", "start", "stop", "tag").mapInArrow(fetch, PART)


def digested(found: DataFrame) -> DataFrame:
    """(url, length, sha256) of the parts of each URL. A URL's bytes are one message, so they pass one
    task in order, that holds a part of them; write the parts first, or they are downloaded again."""

    def digest(batches):
        url, length, hasher = None, 0, hashlib.sha256()

        def row():
            kinds = (pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((url, length, hasher.hexdigest()), kinds)], names=["url", "length", "sha256"])

        for batch in batches:
            for u, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if u != url:
                    if url is not None:
                        yield row()
                    url, length, hasher = u, 0, hashlib.sha256()
                data = content.as_buffer()
                hasher.update(data)
                length += len(data)
        if url is not None:
            yield row()

    dealt = found.repartition("url").sortWithinPartitions("url", "part").select("url", "content")
    return dealt.mapInArrow(digest, "url string, length long, sha256 string")


def verified(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``rows`` of :func:`fetched`, failing on a digest other than (url, expected)."""
    joined = rows.join(expected.select("url", "expected"), "url", "left")
    wrong = F.concat(F.lit("download "), F.col("url"), F.lit(" has digest "), F.col("sha256"), F.lit(", not "), F.col("expected"))
    right = F.col("expected").isNull() | (F.lower("expected") == F.col("sha256"))
    return joined.withColumn("content", F.when(right, F.col("content")).otherwise(F.raise_error(wrong).cast("binary"))).drop("expected")
