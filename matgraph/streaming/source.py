"""Logs of progress events as a data source of Spark's, for batches and streams.

A log is a folder of Parquet files (or one file) that grows by files whose names sort after those
that are there. Its unit is a row group; an offset counts units in the order of files, and
names the last file, so that a log that was changed behind the offset is told and not read wrongly.
Between two offsets the same rows come again, so a stream that ends in a batch goes on from its
checkpoint. Row groups are read by tasks, and only the columns that are asked for.

    spark.dataSource.register(EventSource)
    spark.readStream.format("matgraph_events").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


@dataclass
class Unit(InputPartition):
    """A row group of a file of the log."""

    file: str
    group: int


def _opened(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def units_of(path: str) -> list[Unit]:
    """All row groups, in the order of file names."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        files = [inner]
    else:
        found = system.get_file_info(fs.FileSelector(inner, recursive=False))
        files = sorted(f.path for f in found if f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
    return [Unit(f, k) for f in files for k in range(pq.ParquetFile(f, filesystem=system).num_row_groups)]


def _read(path: str, unit: Unit, columns: list[str]) -> Iterator[Any]:
    import pyarrow.parquet as pq

    system, _ = _opened(path)
    file = pq.ParquetFile(unit.file, filesystem=system)
    for batch in file.iter_batches(row_groups=[unit.group], columns=columns):
        yield batch.select(columns)


class _Batch(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[Unit]:
        return units_of(self.path)

    def read(self, partition: Unit) -> Iterator[Any]:
        yield from _read(self.path, partition, self.columns)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def initialOffset(self) -> dict:
        return {"units": 0, "last": ""}

    def latestOffset(self) -> dict:
        units = units_of(self.path)
        return {"units": len(units), "last": units[-1].file if units else ""}

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        units = units_of(self.path)
        for offset in (start, end):
            n = offset["units"]
            if n > len(units) or n and units[n - 1].file != offset["last"]:
                raise ValueError(f"the log at {self.path} was changed before its unit {n}, which was the last of {offset['last']}")
        return units[start["units"] : end["units"]]

    def read(self, partition: Unit) -> Iterator[Any]:
        yield from _read(self.path, partition, self.columns)


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matgraph_events"

    def schema(self) -> Any:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        units = units_of(self.options["path"])
        if not units:
            raise ValueError(f"no files at {self.options['path']} to take a schema from; give one")
        return from_arrow_schema(pq.ParquetFile(units[0].file, filesystem=_opened(self.options["path"])[0]).schema_arrow)

    def reader(self, schema: Any) -> DataSourceReader:
        return _Batch(self.options["path"], schema.names)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _Stream(self.options["path"], schema.names)


def register(spark: Any) -> None:
    """Make ``matgraph_events`` known to a session. Workers get the classes by value, as they may not
    have this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(EventSource)
