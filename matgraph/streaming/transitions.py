"""The transition log of builds as a stream with a state for each build.

Events may come out of order, as late as the watermark allows: a build keeps those that the
watermark hasn't passed, with a timer for the first of them. When it fires, the events up to the
watermark are taken in order, and one that shows another status than before is a transition,
given once. A state is one status and the events that are still open, so no task ever
has a build's whole history.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from matgraph.operators.executor import own_session
from matgraph.operators.shipping import ship

OUT = "build long, event_id long, status string, previous string"


class Transitions(StatefulProcessor):
    """Over rows (build, at in microseconds, event_id, status)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", StructType([StructField("status", StringType())]))
        event = StructType([StructField("at", LongType()), StructField("event_id", LongType())])
        self.open = handle.getMapState("open", event, StructType([StructField("status", StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if key[0] is None:
            return  # only moves the watermark
        for row in rows:
            self.open.updateValue((row["at"], row["event_id"]), (row["status"],))
        self._wait()
        yield from ()

    def _wait(self) -> None:
        """One timer, for the first of the open events."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        first = min((k[0] for k in self.open.keys()), default=None)
        if first is not None:
            self.handle.registerTimer(first // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((k[0], k[1], v[0]) for k, v in self.open.iterator() if k[0] <= passed)
        before = self.status.get()[0] if self.status.exists() else None
        seen = self.status.exists()
        for at, event_id, status in ready:
            if not seen or status != before:
                yield Row(build=key[0], event_id=event_id, status=status, previous=before)
            before, seen = status, True
            self.open.removeKey((at, event_id))
        if ready:
            self.status.update((before,))
        self._wait()

    def close(self) -> None:
        pass


def transitions(events: DataFrame, late: str) -> DataFrame:
    """The streaming transitions of (build, at, event_id, status) rows, ``at`` a time stamp with zone;
    events that come more than ``late`` after the latest one are dropped. Needs the RocksDB state store."""
    timed = events.withWatermark("at", late)
    rows = timed.select("build", F.col("at").alias("event_time"), F.unix_micros("at").alias("at"), "event_id", "status")
    return rows.groupBy("build").transformWithState(statefulProcessor=Transitions(), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session with the options of ``spark`` and the RocksDB state store, on the same context."""
    own = own_session(spark)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def replay(spark: SparkSession, events: DataFrame, root: str, late: str = "7 days") -> DataFrame:
    """Run :func:`transitions` over a stream of (build, at, event_id, status) that ends, up to its last
    event, and read the result. A batch's rows replace those that it wrote before, so they are
    there once if a run breaks off and is started again with the same ``root``."""
    own = events.sparkSession
    ship(own)
    out = root if "://" in root or root.startswith("file:") else f"file://{root}"
    schema = "build long, at timestamp, event_id long, status string"
    # Rows without a build, far ahead, move the watermark past all others at the end.
    own.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/end")
    both = events.unionByName(own.readStream.schema(schema).parquet(f"{out}/end"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/transitions/batch={number}")

    def run() -> None:
        query = transitions(both, late).writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
        # Sources that can't be asked for an end get one batch in a run, which may be one that broke off.
        if any(p["numInputRows"] for p in query.recentProgress):
            run()

    run()
    # The first such row moves the watermark, and the batch of the second works with it.
    while (ends := own.read.schema(schema).parquet(f"{out}/end").count()) < 2:
        end = f"SELECT CAST(NULL AS LONG) AS build, TIMESTAMP'9999-01-01 00:00:00' AS at, {ends}L AS event_id, '' AS status"
        own.sql(end).write.mode("append").parquet(f"{out}/end")
        run()
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{out}/transitions").drop("batch")
