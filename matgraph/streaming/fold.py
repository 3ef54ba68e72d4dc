"""Progress events as a structured stream.

The run's own channel is lossy and has no event time; kept as files, its events can
be replayed: the last event of each build and span of time, with a watermark that
lets state go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_in_span(events: DataFrame, span: str = "1 hour", late: str = "7 days") -> DataFrame:
    """A streaming aggregate of (user_id, ts, event_id, value) rows; a ``ts`` without zone
    is read in the session's, as watermarks need a time stamp with one. Events of spans that ended
    more than ``late`` before the latest event of earlier batches are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    last = F.max(F.struct("ts", "event_id", "value")).alias("last")
    found = timed.groupBy("user_id", F.window("at", span)).agg(last)
    return found.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), F.col("last.event_id").alias("event_id"), F.col("last.value").alias("value"))


def fold_stream(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Run :func:`last_in_span` over all files at ``path`` and read the result. Each
    batch replaces the spans that it changed; the last one wins."""
    schema = spark.read.parquet(path).schema
    # A file source takes folders; a single file is named by a pattern.
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet")
    own = stream.parquet(path) if _is_folder(spark, path) else stream.parquet(folder)
    out = root if "://" in root or root.startswith("file:") else f"file://{root}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/spans")

    query = last_in_span(own).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/spans")
    return rows.groupBy("user_id", "hour").agg(F.max_by(F.struct("event_id", "value"), "batch").alias("x")).select("user_id", "hour", "x.event_id", "x.value")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
