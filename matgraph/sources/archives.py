"""Files and archives as rows: for data that is too much for one machine's disk.

:func:`entries` unpacks archives that are rows of their own, each held by one task. For large ones
:func:`directory` reads only the directories at their ends, and :func:`members` the wanted members,
each by its byte range and in chunks, so a task holds a chunk and an archive is read by many.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from matgraph.operators.shipping import ship

ENTRIES = "archive string, entry string, length long, content binary"
_SCHEMA = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
_PACKED = pa.schema([("path", pa.string()), ("content", pa.binary())])


def safe(entry: str) -> bool:
    """Does an entry stay below the folder it is unpacked into?"""
    p = PurePosixPath(entry.replace("\\", "/"))
    return not p.is_absolute() and ".." not in p.parts


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def _members(data: bytes, only: str | None) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir() and (only is None or m.filename == only):
                    yield m.filename, z.read(m)
        return
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
        for m in t:
            if m.isfile() and (only is None or m.name == only):
                yield m.name, t.extractfile(m).read()


def entries(archives: DataFrame, only: str | None = None) -> DataFrame:
    """The members of zip and tar archives given as (path, content) rows. With ``only``
    just that member is unpacked; a filter on ``entry`` afterwards would inflate all."""

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for name, data in _members(content.as_py(), only):
                    if not safe(name):
                        raise ValueError(f"{path.as_py()}: entry {name!r} leaves the archive")
                    yield pa.RecordBatch.from_pylist([{"archive": path.as_py(), "entry": name, "length": len(data), "content": data}], schema=_SCHEMA)

    ship(archives.sparkSession)
    return archives.select("path", "content").mapInArrow(unpack, ENTRIES)


def packed(rows: DataFrame, target: int = 32 << 20) -> DataFrame:
    """Zip archives of (entry, content) rows as (path, content) rows: each task packs what
    it has into archives of about ``target`` bytes of content."""

    def pack(batches):
        buffer, size, number = io.BytesIO(), 0, 0
        z = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)

        def closed() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_pylist([{"path": f"part-{number}.zip", "content": buffer.getvalue()}], schema=_PACKED)

        for batch in batches:
            for entry, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py() or b""
                z.writestr(zipfile.ZipInfo(entry.as_py()), data)
                size += len(data)
                if size >= target:
                    yield closed()
                    buffer, size, number = io.BytesIO(), 0, number + 1
                    z = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
        if size or z.namelist():
            yield closed()

    return rows.selectExpr("entry", "cast(content as binary) as content").mapInArrow(pack, "path string, content binary")


def opened(path: str) -> Any:
    """A seekable stream of a file that pyarrow opens: local or mounted, or on a file system that it
    has a client for."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class Counted(io.RawIOBase):
    """A stream that counts the bytes that are read from it."""

    def __init__(self, inner: Any):
        self.inner, self.n = inner, 0

    def read(self, size: int = -1) -> bytes:
        data = self.inner.read() if size < 0 else self.inner.read(size)
        self.n += len(data)
        return data

    def seek(self, to: int, whence: int = 0) -> int:
        self.inner.seek(to, whence)
        return self.inner.tell()

    def tell(self) -> int:
        return self.inner.tell()

    def seekable(self) -> bool:
        return True


DIRECTORY = "archive string, entry string, length long, packed long, offset long, method int, crc long, bytes_read long"
MEMBER = "archive string, entry string, part int, content binary, length long, sha256 string, bytes_read long"
_STORED, _DEFLATED, _ENCRYPTED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, 1


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def directory(paths: DataFrame) -> DataFrame:
    """DIRECTORY rows: the files in zip archives given as (path) rows, from the directories at the
    archives' ends. ``bytes_read`` is what was read of the archive for that."""

    def listed(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    counted = Counted(f)
                    with zipfile.ZipFile(counted) as z:
                        found = [m for m in z.infolist() if not m.is_dir()]
                for m in found:
                    if not safe(m.filename):
                        raise ValueError(f"{path}: entry {m.filename!r} leaves the archive")
                    if m.flag_bits & _ENCRYPTED or m.compress_type not in (_STORED, _DEFLATED):
                        raise ValueError(f"{path}: entry {m.filename!r} is encrypted, or packed by method {m.compress_type}")
                for k in range(0, len(found), 10_000):
                    rows = [(path, m.filename, m.file_size, m.compress_size, m.header_offset, m.compress_type, m.CRC, counted.n) for m in found[k : k + 10_000]]
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_names(DIRECTORY))

    ship(paths.sparkSession)
    return paths.select("path").mapInArrow(listed, DIRECTORY)


def _inflated(f: Counted, packed: int, method: int, offset: int, chunk: int) -> Iterator[bytes]:
    """A member's bytes, in pieces of at most about ``chunk``, from the range that it takes."""
    f.seek(offset)
    header = struct.unpack("<4s5H3I2H", f.read(30))
    f.seek(offset + 30 + header[-2] + header[-1])  # name and extra fields, as long as this header says
    inflate = zlib.decompressobj(-15) if method == _DEFLATED else None
    while packed > 0:
        data = f.read(min(chunk, packed))
        if not data:
            raise EOFError("the archive ends within a member")
        packed -= len(data)
        if inflate is None:
            yield data
            continue
        while data:
            yield inflate.decompress(data, chunk)
            data = inflate.unconsumed_tail
    if inflate is not None:
        yield inflate.flush()


def members(rows: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """MEMBER rows: the content of the members that DIRECTORY rows name, in parts of about ``chunk``
    bytes; the last part (and no other) has the member's length and digest, and what was read of the
    archive for it. Checksums are compared."""

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                digest, crc, length, part, held = hashlib.sha256(), 0, 0, 0, b""
                with opened(r["archive"]) as f:
                    counted = Counted(f)
                    for data in _inflated(counted, r["packed"], r["method"], r["offset"], chunk):
                        digest.update(data)
                        crc, length = zlib.crc32(data, crc), length + len(data)
                        held += data
                        if len(held) > chunk:
                            yield row(r, part, held[:chunk], None, None, None)
                            held, part = held[chunk:], part + 1
                if crc != r["crc"] or length != r["length"]:
                    raise ValueError(f"{r['archive']}: entry {r['entry']!r} isn't what the directory says")
                yield row(r, part, held, length, digest.hexdigest(), counted.n)

    def row(r, part, content, *ends):
        cols = (r["archive"], r["entry"], part, content, *ends)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds)], names=_names(MEMBER))

    ship(rows.sparkSession)
    return rows.select("archive", "entry", "length", "packed", "offset", "method", "crc").mapInArrow(read, MEMBER)


def saved(archives: DataFrame, folder: str) -> DataFrame:
    """(path): archives given as (path, content) rows, written by tasks below ``folder``, which driver
    and executors share, as files named by task; a task that runs again replaces its own."""

    def save(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner)
        k = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = f"{TaskContext.get().partitionId():06d}-{k:06d}-{name}"
                with system.open_output_stream(f"{inner}/{at}") as f:
                    f.write(content.as_buffer())
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at}"])], names=["path"])

    ship(archives.sparkSession)
    return archives.select("path", "content").mapInArrow(save, "path string")
