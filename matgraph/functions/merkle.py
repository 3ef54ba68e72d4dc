"""Digests of file trees folder by folder, as tables.

A file's digest is SHA-256 of its content. A folder's is that of its entries' lines, in the order of
names: kind (``f`` or ``d``), digest and name, joined by spaces; lines by U+000A. Levels are folded from the
deepest up, so no row ever holds more than one folder's entries. Of a folder of more than ``FAN``
entries these are first folded in buckets, by the leading hex digits of the SHA-256 of their
names, two digits at a time: a bucket is a line of kind ``b``, named by its digits. Where a folder's
digest has to be that of all its lines, however many, ``buckets=False`` streams these through a task.

After a change only what lies above the changed files is folded again, from the digests that the
tree keeps; no other file is read.

Defined results: a null content is empty; a path that repeats in a root is an error of the caller's, and
both lines count; a root without files has no digest; empty folders don't count.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matgraph.operators.scratch import new_folder
from matgraph.operators.shipping import ship

FAN = 256
TREE = "root string, path string, parent string, name string, depth int, kind string, digest string"


def _placed(path: Column) -> dict[str, Column]:
    """Columns of a node from its path, which is empty for a root."""
    parts = F.split(path, "/")
    top = F.size(parts) == 1
    return {
        "parent": F.when(path != "", F.when(top, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))),
        "name": F.element_at(parts, -1),
        "depth": F.when(path == "", 0).otherwise(F.size(parts)),
    }


def _nodes(rows: DataFrame, kind: str, *more: str) -> DataFrame:
    return rows.withColumns(_placed(F.col("path"))).withColumn("kind", F.lit(kind)).select("root", "path", "parent", "name", "depth", "kind", "digest", *more)


def leaves(files: DataFrame) -> DataFrame:
    """The nodes of (root, path, content) rows."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return _nodes(files.select(F.col("root").cast("string").alias("root"), F.col("path").cast("string").alias("path"), F.sha2(content, 256).alias("digest")), "f")


def _streamed(own: DataFrame) -> DataFrame:
    """(root, path, digest) of folders without buckets. A folder's lines are one message: they are
    sorted by Spark, that spills, and a task holds a batch of them."""

    def digested(batches):
        held, total = None, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["root", "path", "digest"])

        for batch in batches:
            found = []
            for root, path, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held == (root, path):
                    total.update(b"\n")
                else:
                    if held is not None:
                        found.append((*held, total.hexdigest()))
                    held, total = (root, path), hashlib.sha256()
                total.update(line.encode())
            yield rows(found)
        if held is not None:
            yield rows([(*held, total.hexdigest())])

    ship(own.sparkSession)
    dealt = own.repartition("root", "path").sortWithinPartitions("root", "path", "name", "kind", "digest")
    return dealt.select("root", "path", F.concat_ws(" ", "kind", "digest", "name").alias("line")).mapInArrow(digested, "root string, path string, digest string")


def folded(entries: DataFrame, buckets: bool = True) -> DataFrame:
    """(root, path, digest) of the folders whose entries these are, all of one depth."""
    own = entries.select("root", F.col("parent").alias("path"), "name", "kind", "digest")
    if not buckets:
        return _streamed(own)
    sizes = own.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n"))
    # As many digits as leave about FAN entries to a bucket.
    digits = sizes.filter(F.col("n") > FAN).withColumn("digits", F.ceil(F.log(16.0, F.col("n") / FAN)).cast("int"))
    most = digits.agg(F.max("digits")).first()[0] or 0
    if most:
        own = own.join(digits.drop("n"), ["root", "path"], "left").withColumn("key", F.substr(F.sha2("name", 256), F.lit(1), F.coalesce("digits", F.lit(0)))).drop("digits")
    else:
        own = own.withColumn("key", F.lit(""))

    def lines(rows: DataFrame, *keys: str) -> DataFrame:
        entry = F.struct("name", F.concat_ws(" ", "kind", "digest", "name").alias("line"))
        listed = F.array_sort(F.collect_list(entry))
        return rows.groupBy("root", "path", *keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), 256).alias("digest"))

    for length in range(most, 0, -1):
        if length != most and (most - length) % 2:
            continue
        # Buckets of this many digits become lines of those of two less.
        now = F.length("key") >= length
        shorter = lines(own.filter(now), "key").select("root", "path", F.col("key").alias("name"), F.lit("b").alias("kind"), "digest", F.col("key"))
        own = own.filter(~now).unionByName(shorter.withColumn("key", F.substr("key", F.lit(1), F.lit(max(0, length - 2)))))
    return lines(own)


def _kept(spark, df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def tree(files: DataFrame, buckets: bool = True) -> DataFrame:
    """All nodes of the trees of (root, path, content) rows, TREE; a root's own path is empty. The
    table is below the session's shared folder."""
    spark = files.sparkSession
    folder = new_folder(spark, "tree")
    base = _kept(spark, leaves(files), folder, "files")
    deepest = base.agg(F.max("depth")).first()[0] or 0
    found, below = [base], None
    for depth in range(deepest, 0, -1):
        entries = base.filter(F.col("depth") == depth)
        entries = entries if below is None else entries.unionByName(below)
        below = _kept(spark, _nodes(folded(entries, buckets), "d"), folder, f"folders{depth - 1}")
        found.append(below)
    return _union(found)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """(root, n_files, digest) of a tree's table."""
    return nodes.groupBy("root").agg(F.count_if(F.col("kind") == "f").alias("n_files"), F.max(F.when(F.col("depth") == 0, F.col("digest"))).alias("digest"))


def changed(nodes: DataFrame, files: DataFrame, buckets: bool = True) -> DataFrame:
    """The tree's table after (root, path, content, removed) rows: files that are new or have other
    content, or are removed. Of the tree, only the entries of folders above them are read again;
    ``buckets`` is what the tree was made with."""
    spark = nodes.sparkSession
    folder = new_folder(spark, "tree")
    gone = files.select(F.col("root").cast("string").alias("root"), F.col("path").cast("string").alias("path"), "removed")
    new = _kept(spark, leaves(files).join(gone, ["root", "path"]), folder, "files")
    deepest = new.agg(F.max("depth")).first()[0] or 0
    found, above = [new], None
    for depth in range(deepest, 0, -1):
        now = new.filter(F.col("depth") == depth)
        now = now if above is None else now.unionByName(above)
        now = _kept(spark, now, folder, f"entries{depth}")
        folders = now.select("root", "parent").distinct()
        others = nodes.filter(F.col("depth") == depth).join(folders, ["root", "parent"], "left_semi").join(now.select("root", "path"), ["root", "path"], "left_anti")
        entries = others.select(*nodes.columns).unionByName(now.filter("not removed").select(*nodes.columns))
        held = _nodes(folded(entries, buckets), "d")
        left = folders.withColumnRenamed("parent", "path").join(held.select("root", "path"), ["root", "path"], "left_anti")
        empty = _nodes(left.withColumn("digest", F.lit("")), "d")
        above = _kept(spark, held.withColumn("removed", F.lit(False)).unionByName(empty.withColumn("removed", F.lit(True))), folder, f"folders{depth - 1}")
        found.append(above)
    touched = _union(found)
    kept = nodes.join(touched.select("root", "path"), ["root", "path"], "left_anti").select(*nodes.columns)
    return kept.unionByName(touched.filter("not removed").select(*nodes.columns))
