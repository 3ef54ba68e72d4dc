"""Logs of events as a data source, and the stream of transitions."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matgraph.streaming import sinks, source, transitions

START = datetime(2024, 1, 1)


def write(folder, name, rows, groups=2):
    folder.mkdir(exist_ok=True)
    table = pa.table({"build": [r[0] for r in rows], "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "event_id": [r[2] for r in rows], "status": [r[3] for r in rows]})
    pq.write_table(table, folder / name, row_group_size=max(1, len(rows) // groups))


def events(n, builds=7, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(builds), START + timedelta(minutes=5 * k, microseconds=rng.choice([0, 0, 1, 999])), k, rng.choice(["running", "waiting", "done"])) for k in range(n)]


def plain_transitions(rows):
    last, out = {}, []
    for build, _, event_id, status in sorted(rows, key=lambda r: (r[1], r[2])):
        if last.get(build) != status:
            out.append((build, event_id, status, last.get(build)))
        last[build] = status
    return sorted(out, key=repr)


def test_a_log_as_a_table(spark, tmp_path):
    rows = events(100)
    for k in range(4):
        write(tmp_path / "log", f"{k}.parquet", rows[25 * k : 25 * k + 25])
    (tmp_path / "log" / "_notes.parquet").write_text("no table")
    source.register(spark)
    log = spark.read.format("matgraph_events").option("path", str(tmp_path / "log")).load()
    assert sorted(map(tuple, log.collect())) == sorted(rows)
    assert [u.group for u in source.units_of(f"file://{tmp_path}/log")] == [0, 1, 2] * 4
    assert log.select("status").distinct().count() == 3
    one = spark.read.format("matgraph_events").option("path", str(tmp_path / "log" / "2.parquet")).load()
    assert sorted(map(tuple, one.collect())) == sorted(rows[50:75])


def run(spark, path, out, keep):
    log = spark.readStream.format("matgraph_events").option("path", str(path)).load()
    query = log.writeStream.option("checkpointLocation", f"file://{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def test_a_stream_that_ends_in_a_batch_goes_on(spark, tmp_path):
    """Rows come once each: a batch that broke off is read again between its offsets."""
    rows = events(90)
    source.register(spark)
    write(tmp_path / "log", "0.parquet", rows[:30])
    tries = []

    def keep(batch, number):
        tries.append((number, sorted(r["event_id"] for r in batch.collect())))
        if len(tries) == 2:
            raise ValueError("killed")
        batch.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={number}")

    run(spark, tmp_path / "log", tmp_path, keep)
    write(tmp_path / "log", "1.parquet", rows[30:60])
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path / "log", tmp_path, keep)
    write(tmp_path / "log", "2.parquet", rows[60:])  # comes meanwhile, and after that batch
    for _ in range(2):  # the batch that broke off, and then what came since
        run(spark, tmp_path / "log", tmp_path, keep)
    assert [n for n, _ in tries] == [0, 1, 1, 2] and tries[1] == tries[2]
    got = spark.read.parquet(f"file://{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.select("build", "ts", "event_id", "status").collect())) == sorted(rows)
    assert got.count() == spark.read.format("matgraph_events").option("path", str(tmp_path / "log")).load().count()


def test_a_log_that_was_changed_is_told(spark, tmp_path):
    rows = events(20)
    source.register(spark)
    write(tmp_path / "log", "5.parquet", rows[:10])
    run(spark, tmp_path / "log", tmp_path, lambda batch, number: None)
    write(tmp_path / "log", "4.parquet", rows[10:])
    with pytest.raises(Exception, match="changed before its unit"):
        run(spark, tmp_path / "log", tmp_path, lambda batch, number: batch.count())


def stream(own, folder):
    schema = "build long, ts timestamp_ntz, event_id long, status string"
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    return rows.select("build", F.col("ts").cast("timestamp").alias("at"), "event_id", "status")


def test_transitions_of_events_out_of_order(spark, tmp_path):
    """Many files, each with events as much as a day out of order, one to a batch."""
    rows = events(600, builds=5)
    rng = random.Random(2)
    dealt = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 20)))
    for k in range(6):
        write(tmp_path / "log", f"{k}.parquet", dealt[100 * k : 100 * k + 100])
    own = transitions.stateful_session(spark)
    got = transitions.replay(spark, stream(own, tmp_path / "log"), f"{tmp_path}/out", "1 day")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_transitions(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != own.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_transitions_after_a_broken_run(spark, tmp_path, monkeypatch):
    rows = events(200, builds=4)
    for k in range(3):
        write(tmp_path / "log", f"{k}.parquet", rows[70 * k : 70 * k + 70])
    own = transitions.stateful_session(spark)
    tries = []
    frame = type(spark.range(1))
    write_of = frame.write.fget

    def failing(df):
        tries.append(1)
        if len(tries) == 3:
            raise ValueError("killed")
        return write_of(df)

    monkeypatch.setattr(frame, "write", property(failing))
    with pytest.raises(Exception, match="killed"):
        transitions.replay(spark, stream(own, tmp_path / "log"), f"{tmp_path}/out", "2 hours")
    monkeypatch.setattr(frame, "write", property(write_of))
    got = transitions.replay(spark, stream(own, tmp_path / "log"), f"{tmp_path}/out", "2 hours")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_transitions(rows)


def test_no_events(spark, tmp_path):
    write(tmp_path / "log", "0.parquet", events(1)[:0])
    own = transitions.stateful_session(spark)
    assert transitions.replay(spark, stream(own, tmp_path / "log"), f"{tmp_path}/out").count() == 0


def test_a_sink_that_fails_once_has_each_batch_once(spark, tmp_path):
    """And the others don't get a batch again; a batch that breaks off between rows and note is replaced."""
    rows = events(90)
    source.register(spark)
    got: dict = {"a": [], "b": []}
    fail = {("b", 1)}

    def listed(name):
        def put(batch, number):
            if (name, number) in fail:
                fail.discard((name, number))
                raise OSError(f"{name} is away")
            got[name].append((number, sorted(r["event_id"] for r in batch.collect())))

        return put

    root = f"file://{tmp_path}/out"
    fan = lambda: sinks.FanOut(spark, root, {"a": listed("a"), "b": listed("b"), "c": sinks.to_folder(f"{root}/c")})
    for k in range(3):
        write(tmp_path / "log", f"{k}.parquet", rows[30 * k : 30 * k + 30])
        try:
            run(spark, tmp_path / "log", tmp_path, fan())
        except Exception as e:
            assert "b is away" in str(e) and k == 1
            assert fan().taken("a") == [0, 1] and fan().taken("b") == [0]
            run(spark, tmp_path / "log", tmp_path, fan())
    whole = [(k, list(range(30 * k, 30 * k + 30))) for k in range(3)]
    assert got == {"a": whole, "b": whole} and fan().taken("b") == [0, 1, 2]
    kept = spark.read.parquet(f"{root}/c")
    assert sorted(r["event_id"] for r in kept.collect()) == list(range(90))
    (tmp_path / "out" / "_sinks" / "c" / "000000000002").unlink()  # as if it broke off before its note
    sinks.FanOut(spark, root, {"c": sinks.to_folder(f"{root}/c")})(spark.createDataFrame(rows[60:], "build long, ts timestamp_ntz, event_id long, status string"), 2)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{root}/c").collect()) == list(range(90))


def test_names_of_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="bare file name"):
        sinks.FanOut(spark, f"file://{tmp_path}", {"a/b": print})
