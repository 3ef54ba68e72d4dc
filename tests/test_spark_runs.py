"""What runs take from Spark: sessions of steps, progress of tasks, frames that are held."""

import threading
import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import matgraph as m
from matgraph.operators.files import files_at, manifest_of
from matgraph.plans.nodes import label_of

DATA = "/root/testdata/sf0.001"


class Told(m.Reporter):
    def __init__(self):
        self.seen = []

    def update(self, snapshot):
        self.seen.append(snapshot)

    close = update


def run(root, node, **kw):
    return m.realize(f"file://{root}", node, executor=m.LocalExecutor(default_pool_size=4), **kw)


def persisted(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_steps_have_sessions_of_their_own(spark, tmp_path):
    spark.range(2).createOrReplaceTempView("everyones")
    meet = threading.Barrier(2)

    @m.derivation(lambda n, *_: f"own{n}")
    def own(n, rows=None):
        here = m.session()
        here.conf.set("spark.sql.shuffle.partitions", str(n))
        here.range(n).createOrReplaceTempView("mine")
        meet.wait(20)
        time.sleep(0.2)
        read = [here.conf.get("spark.sql.shuffle.partitions"), here.table("mine").count(), here.table("everyones").count()]
        if rows is not None:
            read.append(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return here.createDataFrame([(str(x),) for x in read], "x string")

    @m.derivation("rows")
    def rows():
        return m.session().range(3)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    a, b = run(tmp_path, m.Gather(own(3), own(5, rows())))
    assert sorted(r[0] for r in a.collect()) == ["2", "3", "3"] and sorted(r[0] for r in b.collect()) == ["2", "5", "5", "5"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and not spark.catalog.tableExists("mine")
    assert SparkSession.getActiveSession()._jsparkSession.hashCode() == spark._jsparkSession.hashCode()


def test_progress_of_tasks(spark, tmp_path):
    """Done and total only grow, both come to the tracker's figures, and to all tasks."""

    @m.derivation("slow")
    def slow():
        def wait(batches):
            for b in batches:
                time.sleep(1.0)
                yield b

        return m.session().range(0, 80, 1, 16).mapInArrow(wait, "id long").groupBy((F.col("id") % 3).alias("k")).count()

    @m.derivation("tells")
    def tells():
        m.session().range(10).count()
        m.progress().total(7)
        time.sleep(1.5)
        return m.session().range(1)

    told = Told()
    root = slow()
    run(tmp_path, m.Gather(root, tells()), reporter=told)
    label = label_of(root)
    last = told.seen[-1]
    samples = [s for s in last.samples if s[0] == label]
    assert len(samples) > 2 and samples == sorted(samples, key=lambda s: s[1])
    assert all(a[2] <= b[2] and a[3] <= b[3] for a, b in zip(samples, samples[1:])) and all(0 <= done <= total for _, _, done, total in samples)
    assert samples[0][3] >= 16 and samples[-1][2] == samples[-1][3] == last.builds[label].done
    assert any(0 < s.builds[label].done < s.builds[label].total for s in told.seen if s.builds[label].done is not None)
    assert last.builds[label_of(tells())].total == 7 and last.builds[label_of(tells())].done is None
    rows = last.tasks(spark).filter(F.col("label") == label)
    assert rows.count() == len(samples) and rows.agg(F.max("done")).first()[0] == samples[-1][2]
    assert manifest_of(files_at(f"file://{tmp_path}", spark), label)["rows"] == 3


def counted(spark, path, count):
    def pass_on(batches):
        count.add(1)
        yield from batches

    return spark.read.parquet(path).select("l_orderkey", "l_quantity").mapInArrow(pass_on, "l_orderkey long, l_quantity double")


@pytest.mark.parametrize("failing", [False, True])
def test_a_frame_that_several_read_is_worked_out_once(spark, tmp_path, failing):
    count = spark.sparkContext.accumulator(0)
    before = persisted(spark)

    @m.expression()
    def lines():
        return counted(spark, f"{DATA}/lineitem.parquet", count).repartition(3)

    @m.expression()
    def handed_on(frame):
        return frame

    @m.derivation(lambda rows, k: f"read{k}")
    def read(rows, k):
        if failing and k == 2:
            raise ValueError("bad")
        return rows.groupBy((F.col("l_orderkey") % (k + 2)).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    source = lines()
    node = m.Gather(read(source, 0), read(source, 1), read(handed_on(source), 2))
    if failing:
        with pytest.raises(m.RealizeError):
            run(tmp_path, node)
    else:
        n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
        assert [sum(r["n"] for r in part.collect()) for part in run(tmp_path, node)] == [n] * 3
    assert count.value == 1  # one task of one scan: the file is one part
    assert persisted(spark) == before
    run(tmp_path, m.Gather(read(source, 0), read(source, 1)))  # from the vault: nothing reads, nothing is held
    assert count.value == 1 and persisted(spark) == before


def test_a_frame_with_one_reader_is_not_held(spark, tmp_path):
    seen = []

    @m.expression()
    def rows():
        return spark.range(5)

    @m.derivation("one")
    def one(frame):
        seen.append(frame.storageLevel.useMemory)
        return frame

    assert run(tmp_path, one(rows())).count() == 5 and seen == [False]


def test_frames_are_let_go_after_an_interrupt(spark, tmp_path):
    before = persisted(spark)

    @m.expression()
    def rows():
        return spark.range(5)

    @m.derivation(lambda frame, k: f"part{k}")
    def part(frame, k):
        frame.count()
        if k:
            time.sleep(5)
        return frame

    @m.expression()
    def stop(done):
        raise KeyboardInterrupt

    source = rows()
    with pytest.raises(KeyboardInterrupt):
        run(tmp_path, m.Gather(stop(part(source, 0)), part(source, 1)))
    assert persisted(spark) == before
