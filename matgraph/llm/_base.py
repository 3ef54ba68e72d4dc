"""What the operators of this subpackage share: scratch tables in the cluster's
shared folder, and the definition of a word."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matgraph.operators.scratch import new_folder
from matgraph.operators.shipping import ship

#: White space as every contract here defines it: the space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: For rows that hold whole texts: what the Parquet reader decodes at once, and what goes
#: to a Python worker at once. Spark's own values count rows of a few bytes.
BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}
#: The shuffle files of a staged table's job go as soon as the table is written.
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: Of each session and option that is set: by how many users, and what it was before the first.
_users: dict[tuple[int, str], list] = {}
_changing = threading.Lock()


@contextlib.contextmanager
def options(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Set the session's options for the plans that run inside. Users may overlap, in one thread
    or several, and ask for equal values: the last one out restores what was before the first."""
    session = spark._jsparkSession.hashCode()
    with _changing:
        for k, v in values.items():
            users = _users.setdefault((session, k), [0, spark.conf.get(k, None)])
            users[0] += 1
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _changing:
            for k in values:
                users = _users[session, k]
                users[0] -= 1
                if not users[0]:
                    del _users[session, k]
                    spark.conf.unset(k) if users[1] is None else spark.conf.set(k, users[1])


def map_arrow(rows: DataFrame, of_batches, schema) -> DataFrame:
    """``mapInArrow`` by a worker that has this package and gives back its memory. Plans over
    texts run with BATCHES: in :func:`staged`, or inside :func:`options`."""
    ship(rows.sparkSession)
    return rows.mapInArrow(tidy(of_batches), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. This cuts the lineage and
    survives the loss of any executor. The job runs with BATCHES."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    with options(spark, BATCHES | _CLEANUP):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    if (made := _made.get()) is not None:
        made.append(found)
    return found


#: The staged tables of the scope that is open, if one is.
_made: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("matgraph_made", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Remove the staged tables that are made inside, but for those put into the list."""
    token = _made.set([])
    made = _made.get()
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        _made.reset(token)
        left = {t.staged_at for t in kept}
        drop_staged(*(t for t in made if t.staged_at not in left))
        if (outer := _made.get()) is not None:
            outer.extend(t for t in made if t.staged_at in left)


def drop_staged(*tables: DataFrame) -> None:
    """Remove tables that :func:`staged` gave and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def block_spans(data: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Blocks of a text of about ``size`` bytes, that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield at, end
        at = end


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists from blocks of about ``size`` bytes, so
    that a huge text never becomes one list. ``bytes.split()`` breaks exactly at
    :data:`SPACE`."""
    if len(data) <= size:
        yield data.split()
        return
    for at, end in block_spans(data, size):
        yield data[at:end].split()


def tidy(of_batches):
    """A function for mapInArrow that gives its memory back to the system at the end of
    the task, as Spark keeps its Python workers for other tasks."""

    @functools.wraps(of_batches)
    def run(batches):
        yield from of_batches(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return run


def column_of(batch: pa.RecordBatch, i: int) -> Iterator:
    """The values of a column one by one, and not as a list."""
    return (x.as_py() for x in batch.column(i))
