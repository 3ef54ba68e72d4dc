"""Several sinks of one stream, each with its own committed batch number.

A stream's batches come at least once: a batch in which something fails comes again after the
restart. Each sink notes below a shared folder the batches that it has taken; of a batch that comes
again it gets only what it hasn't taken, so one sink's fault neither keeps a batch from the others nor
gives it to them twice. A sink that writes a folder for each batch number (``to_folder``) is whole even if it
breaks off between its rows and its note.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from matgraph.operators.files import files_at

Sink = Callable[[DataFrame, int], Any]


class FanOut:
    """For ``foreachBatch``: hands each batch to all sinks, and raises the first error when all have had
    it, so that the batch comes again."""

    def __init__(self, spark: SparkSession, root: str, sinks: dict[str, Sink]):
        if bad := [name for name in sinks if not name or "/" in name or name.startswith(("_", "."))]:
            raise ValueError(f"a sink's name is a bare file name, not {bad[0]!r}")
        self.sinks = dict(sinks)
        self.notes = files_at(f"{root}/_sinks", spark)

    def _note(self, name: str, number: int) -> str:
        return f"{name}/{number:012d}"

    def taken(self, name: str) -> list[int]:
        """The batches that a sink has noted."""
        return [int(n) for n in self.notes.names(name) if n.isdigit()] if self.notes.exists(name) else []

    def __call__(self, batch: DataFrame, number: int) -> None:
        waiting = [name for name in self.sinks if not self.notes.exists(self._note(name, number))]
        if len(waiting) > 1:
            batch = batch.persist()  # worked out once for all of them
        errors: list[Exception] = []
        try:
            for name in waiting:
                try:
                    self.sinks[name](batch, number)
                    self.notes.mkdir(name)
                    self.notes.write(self._note(name, number), b"")
                except Exception as e:
                    errors.append(e)
        finally:
            if len(waiting) > 1:
                batch.unpersist()
        if errors:
            raise errors[0]


def to_folder(path: str, rows_of: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Sink:
    """A sink that writes what ``rows_of`` makes of a batch to a Parquet folder of its number below
    ``path``, in place of what an earlier try left there."""

    def put(batch: DataFrame, number: int) -> None:
        rows_of(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
