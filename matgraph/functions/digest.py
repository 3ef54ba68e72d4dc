"""Digests of file trees: on a local folder, and on a table of files."""

from __future__ import annotations

import hashlib
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matgraph.operators.shipping import ship


def hash_directory_tree(hasher: Any, dir: str | Path) -> None:
    """Feed relative path and content of every file, in the order of paths. Empty folders
    don't count."""
    root = Path(dir)
    files = {str(p.relative_to(root)): p for p in root.rglob("*") if p.is_file()}
    for name in sorted(files):
        hasher.update(name.encode())
        with open(files[name], "rb") as f:
            while block := f.read(1 << 16):
                hasher.update(block)


def tree_digest(files: DataFrame, root: str = "root", path: str = "path", content: str = "content") -> DataFrame:
    """(root, n_files, digest): what SHA-256 with :func:`hash_directory_tree` gives, of
    the files of each root; a null content is empty.

    A tree's bytes are one message, which has to pass one task in the order of paths; they
    are sorted by Spark, that spills, and digested as they stream by, so a task holds a batch
    of files. Where the value may be another, :func:`tree_digest_of_digests` splits this."""

    def digested(batches):
        held, found = None, []

        def close() -> None:
            if held is not None:
                found.append((held[0], held[1], held[2].hexdigest()))

        for batch in batches:
            for r, p, c in zip(*(batch.column(i) for i in range(3))):
                r = r.as_py()
                if held is None or held[0] != r:
                    close()
                    held = [r, 0, hashlib.sha256()]
                held[1] += 1
                held[2].update(p.as_py())
                if c.is_valid:
                    held[2].update(c.as_buffer())
            yield _digests(found)
            found = []
        close()
        yield _digests(found)

    ship(files.sparkSession)
    rows = files.select(F.col(root).cast("string").alias("root"), F.col(path).cast("binary").alias("path"), F.col(content).cast("binary").alias("content"))
    dealt = rows.repartition("root").sortWithinPartitions("root", "path")
    found = dealt.mapInArrow(digested, "root string, n_files long, digest string")
    return found.select(F.col("root").cast(files.schema[root].dataType).alias(root), "n_files", "digest")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["root", "n_files", "digest"])


def tree_digest_of_digests(files: DataFrame, root: str = "root", path: str = "path", content: str = "content") -> DataFrame:
    """(root, n_files, digest) of sorted paths with the digests of their contents: another
    value, but only digests meet in a task."""
    small = files.select(root, path, F.sha2(F.col(content).cast("binary"), 256).alias("d"))
    each = F.array_sort(F.collect_list(F.concat_ws("\x1f", path, "d")))
    return small.groupBy(root).agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(each, "\n"), 256).alias("digest"))


def label(hash: Column, name: Column) -> Column:
    """The published name of a step, from its binary hash."""
    return F.concat_ws("-", F.lower(F.hex(hash)), name)
