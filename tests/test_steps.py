"""Declaring, addressing and building steps."""

import hashlib
import json
import os
import time

import pytest

from matgraph import (
    OUTPUT,
    ChildFile,
    Constant,
    Derivation,
    Gather,
    LocalExecutor,
    RealizeError,
    compute_hash,
    derivation,
    expression,
    output,
    realize,
)
from matgraph.plans.nodes import key_of, label_of

calls: list = []


@derivation("out.txt")
def greeting(who):
    calls.append(who)
    output().write_text(f"hello {who}")


@derivation("copy.txt")
def length_of(path, factor=1):
    output().write_text(str(len(path.read_text()) * factor))


def build(tmp_path, node, **kw):
    return realize(tmp_path / "vault", node, executor=kw.pop("executor", LocalExecutor({}, default_pool_size=4, poll=0.05)), **kw)


def leftovers(tmp_path):
    return [n for n in os.listdir(tmp_path / "vault") if ".tmp-" in n or n.endswith(".lock")]


def test_builds_once_and_names_by_hash(tmp_path):
    calls.clear()
    node = greeting("world")
    first, second = build(tmp_path, node), build(tmp_path, node)
    assert first == second and first.read_text() == "hello world" and calls == ["world"]
    assert first.name == label_of(node) == f"{node.hash.hex()}-out.txt" and leftovers(tmp_path) == []


def test_addresses():
    a = greeting("x")
    assert a.hash == greeting("x").hash == greeting(who="x").hash != greeting("y").hash
    assert length_of(a).hash == length_of(a, 1).hash != length_of(greeting("y")).hash
    f = lambda x: x
    assert compute_hash(f, "n", ({"a": 1, "b": 2},)) == compute_hash(f, "n", ({"b": 2, "a": 1},))
    assert compute_hash(f, "n", ({"x", "y", "z"},)) == compute_hash(f, "n", ({"z", "y", "x"},))
    different = [("ab", "c"), ("a", "bc"), (1, 2), (12,), ([1, 2],), ((1, 2),), (1.0, 2), ("1", 2), (True, 2), (None, None)]
    assert len({compute_hash(lambda *a: 0, "n", args) for args in different}) == len(different)
    assert compute_hash(f, "n", (1,), version=1) != compute_hash(f, "n", (1,), version=2) != compute_hash(f, "m", (1,), version=2)


def declared(**kw):
    @derivation("same", **kw)
    def body(x):
        output().write_text(x)

    return body("v")


def test_scheduling_hints_are_not_addressed():
    assert declared().hash == declared(pool="other").hash == declared(slots=3, isolate=True).hash != declared(version=2).hash


def test_changed_source_changes_the_address():
    def one():
        def body():
            return 1
        return body

    def two():
        def body():
            return 2
        return body

    assert compute_hash(one(), "n") != compute_hash(two(), "n")


def test_chain_and_computed_names(tmp_path):
    @derivation(lambda tag, n: f"{tag}-{n}.txt")
    def named(tag, n):
        output().write_text(tag * n)

    node = named("ab", 3)
    assert node.name == "ab-3.txt" and build(tmp_path, length_of(node, 2)).read_text() == "12"


def test_none_is_an_ordinary_argument(tmp_path):
    @derivation("n.txt")
    def body(a, path, b=None, other=None):
        output().write_text(f"{a} {path.read_text()} {b} {other.read_text()}")

    assert build(tmp_path, body(None, greeting("p"), None, other=greeting("q"))).read_text() == "None hello p None hello q"


def test_bad_declarations():
    for name in ("a/b", "", ".."):
        with pytest.raises(ValueError):
            Derivation(name, b"h", [], None)
    with pytest.raises(ValueError):
        Derivation("a", b"h", [], None, slots=0)
    with pytest.raises(TypeError, match="Gather"):
        greeting([greeting("x")])
    with pytest.raises(RuntimeError):
        output()
    with pytest.raises(RuntimeError):
        OUTPUT.get()


def test_two_names_of_one_content_are_two_entries(tmp_path):
    h = hashlib.sha256(b"x").digest()
    a, b = (Derivation(n, h, [], lambda _: output().write_text("x")) for n in ("a", "b"))
    assert key_of(a) != key_of(b)
    got = build(tmp_path, Gather(a, b))
    assert [p.name.split("-")[1] for p in got] == ["a", "b"]


def test_folders_expressions_and_children(tmp_path):
    @derivation("dir")
    def tree():
        output().mkdir()
        (output() / "inner.txt").write_text("inner")

    count = []

    @expression()
    def text(path):
        count.append(1)
        return path.read_text()

    node = text(ChildFile(tree(), "inner.txt"))
    assert build(tmp_path, Gather(node, node, Constant({"k": 1}))) == ["inner", "inner", {"k": 1}] and len(count) == 1
    assert build(tmp_path, node) == "inner" and len(count) == 2


def test_no_output_is_an_error_that_names_the_body(tmp_path):
    @derivation("nothing")
    def nothing():
        pass

    with pytest.raises(RealizeError, match=r"test_steps\.py:\d+"):
        build(tmp_path, nothing())
    assert leftovers(tmp_path) == []


def test_a_failing_body_leaves_nothing(tmp_path):
    @derivation("bad")
    def bad():
        output().write_text("half")
        raise ValueError("no")

    with pytest.raises(RealizeError, match="ValueError: no"):
        build(tmp_path, bad())
    assert os.listdir(tmp_path / "vault") == []


def test_stale_temporaries_are_ignored(tmp_path):
    node = greeting("w")
    (tmp_path / "vault").mkdir()
    old = tmp_path / "vault" / f"_{label_of(node)}.tmp-1-deadbeef"
    old.write_text("half")
    assert build(tmp_path, node).read_text() == "hello w" and old.exists()


def test_old_spelling_of_output(tmp_path):
    @derivation("old")
    def old():
        OUTPUT.get().write_text("o")

    assert build(tmp_path, old()).read_text() == "o"


def test_realize_takes_one_step_and_an_executor(tmp_path):
    with pytest.raises(TypeError):
        realize(tmp_path, [greeting("a")], executor=LocalExecutor())
    with pytest.raises(TypeError):
        realize(tmp_path, greeting("a"), executor="serial")


def test_deleted_dependency_of_a_cached_step(tmp_path):
    calls.clear()
    base = greeting("deep")
    top = length_of(base)
    build(tmp_path, top)
    (tmp_path / "vault" / label_of(base)).unlink()
    build(tmp_path, top, prune_cached=True)
    assert calls == ["deep"]
    build(tmp_path, top)
    assert calls == ["deep", "deep"]


# -- datasets


@derivation("numbers")
def numbers(n):
    from pyspark.sql import SparkSession

    calls.append(n)
    return SparkSession.getActiveSession().range(n)


@derivation("doubled", pool="heavy")
def doubled(rows):
    return rows.selectExpr("id * 2 AS id")


def test_datasets_are_published_read_back_and_cached(spark, tmp_path):
    calls.clear()
    for _ in range(2):
        got = build(tmp_path, doubled(numbers(5)))
        assert sorted(r["id"] for r in got.collect()) == [0, 2, 4, 6, 8]
    assert calls == [5] and leftovers(tmp_path) == []
    entry = tmp_path / "vault" / label_of(numbers(5))
    manifest = json.loads((entry / "_matgraph.json").read_text())
    assert manifest["name"] == "numbers" and "id" in manifest["schema"]


def test_a_dataset_without_its_manifest_is_built_again(spark, tmp_path):
    calls.clear()
    build(tmp_path, numbers(3))
    (tmp_path / "vault" / label_of(numbers(3)) / "_matgraph.json").unlink()
    assert build(tmp_path, numbers(3)).count() == 3 and calls == [3, 3]


def test_dataframes_are_no_arguments(spark):
    with pytest.raises(TypeError, match="step that makes it"):
        greeting(spark.range(1))


def test_vault_on_a_hadoop_path(spark, tmp_path):
    from matgraph.operators.files import HadoopFiles, complete

    files = HadoopFiles(f"file://{tmp_path}/h", spark)
    assert files.create("a.lock", b"{}") and not files.create("a.lock", b"{}") and files.read("a.lock") == b"{}"
    files.touch("a.lock")
    assert files.age("a.lock") < 60 and files.names() == ["a.lock"] and files.read("nothing") is None
    spark.range(2).write.parquet(files.uri("_t"))
    assert files.publish("_t", "d") and not complete(files, "d")
    files.write("d/_matgraph.json", b"{}")
    spark.range(3).write.parquet(files.uri("_t"))
    assert files.holds("d", ".parquet") and not files.holds("d", ".csv")
    assert complete(files, "d") and not files.publish("_t", "d") and spark.read.parquet(files.uri("d")).count() == 2
    files.remove("d")
    assert not files.exists("d")


def test_partition_child(spark, tmp_path):
    @derivation("parts")
    def parts():
        spark.range(10).selectExpr("id", "id % 2 AS odd").write.partitionBy("odd").parquet(output().as_uri())

    got = build(tmp_path, ChildFile(parts(), "odd=1"))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5, 7, 9]


def test_other_formats_are_paths(spark, tmp_path):
    @derivation("lines")
    def lines():
        spark.range(3).write.json(output().as_uri())

    got = build(tmp_path, lines())
    assert spark.read.json(got.as_uri()).count() == 3 and build(tmp_path, lines()) == got


# -- concurrency, failures, locks


@derivation("s", pool="p")
def sleeper(tag, seconds):
    time.sleep(seconds)
    output().write_text(tag)


def timed(f):
    at = time.monotonic()
    f()
    return time.monotonic() - at


def test_parallel_and_serial(tmp_path):
    node = Gather(*[sleeper(f"a{i}", 0.4) for i in range(4)])
    assert timed(lambda: build(tmp_path, node, executor=LocalExecutor({"p": 4}))) < 1.2
    node = Gather(*[sleeper(f"b{i}", 0.2) for i in range(3)])
    assert timed(lambda: build(tmp_path, node, executor=LocalExecutor())) >= 0.6


def test_slots_bound_what_runs(tmp_path):
    running, peak = [], []

    def body(slots):
        def run(_):
            running.append(slots)
            peak.append(sum(running))
            time.sleep(0.1)
            running.remove(slots)
            output().write_text("x")
        return run

    steps = [Derivation(f"d{i}", bytes([i]), [], body(s), "p", s) for i, s in enumerate((3, 1, 3, 1, 1, 1))]
    build(tmp_path, Gather(*steps), executor=LocalExecutor({"p": 4}))
    assert max(peak) <= 4 and len(peak) == 6
    with pytest.raises(ValueError, match="20 slots"):
        build(tmp_path, Derivation("wide", b"w", [], body(1), "p", 20), executor=LocalExecutor({"p": 4}))


def test_failures_block_their_dependents_only(tmp_path):
    @derivation("bad")
    def bad():
        raise ValueError("broken")

    with pytest.raises(RealizeError) as e:
        build(tmp_path, Gather(length_of(bad()), greeting("good")))
    assert [type(x) for x in e.value.failed.values()] == [ValueError]
    assert len(e.value.blocked) == 2 and e.value.blocked[-1].startswith("expr-")
    assert (tmp_path / "vault" / label_of(greeting("good"))).exists() and leftovers(tmp_path) == []


def test_fail_fast(tmp_path):
    @derivation("bad", pool="p")
    def bad():
        raise ValueError("broken")

    @expression()
    def bad_value():
        raise KeyError("value")

    for node in (bad(), bad_value()):
        spent = timed(lambda node=node: pytest.raises(RealizeError, build, tmp_path, Gather(sleeper("long", 2.0), node), executor=LocalExecutor({"p": 2}), fail_fast=True))
        assert spent < 1.5


def test_fail_fast_stops_children_and_spark_jobs(spark, tmp_path):
    @derivation("child", pool="p", isolate=True)
    def child():
        import time

        time.sleep(30)

    @derivation("job", pool="p")
    def job():
        from pyspark.sql import functions as F

        def slow(batches):
            for b in batches:
                time.sleep(30)
                yield b

        return spark.range(2).select(F.col("id")).mapInArrow(slow, "id long")

    @derivation("bad", pool="p")
    def bad():
        time.sleep(1)
        raise ValueError("broken")

    spent = timed(lambda: pytest.raises(RealizeError, build, tmp_path, Gather(child(), job(), bad()), executor=LocalExecutor({"p": 3}), fail_fast=True))
    assert spent < 8


def test_isolated_steps(spark, tmp_path):
    @derivation("pid.txt", isolate=True)
    def pid(path):
        import os

        output().write_text(f"{os.getpid()} {path.read_text()}")

    got = build(tmp_path, pid(greeting("iso"))).read_text()
    assert got.endswith("hello iso") and not got.startswith(str(os.getpid()))

    @derivation("crash", isolate=True)
    def crash():
        raise RuntimeError("from the child")

    with pytest.raises(RealizeError, match="from the child"):
        build(tmp_path, crash())


def test_waits_for_a_foreign_lock(tmp_path):
    import threading

    node = greeting("locked")
    vault = tmp_path / "vault"
    vault.mkdir()
    lock, entry = vault / f"{label_of(node)}.lock", vault / label_of(node)
    lock.write_text("{}")
    calls.clear()

    def other():
        time.sleep(0.6)
        entry.write_text("theirs")
        lock.unlink()

    threading.Thread(target=other).start()
    assert timed(lambda: build(tmp_path, node)) >= 0.5 and entry.read_text() == "theirs" and calls == []


def test_takes_over_a_stale_lock_and_keeps_a_successors(tmp_path):
    node = greeting("stale")
    vault = tmp_path / "vault"
    vault.mkdir()
    lock = vault / f"{label_of(node)}.lock"
    lock.write_text("{}")
    os.utime(lock, (time.time() - 3600,) * 2)
    assert build(tmp_path, node, executor=LocalExecutor(lock_stale_after=60)).read_text() == "hello stale" and not lock.exists()

    from matgraph.operators.files import LocalFiles
    from matgraph.operators.locks import BuildLock

    own = BuildLock(LocalFiles(vault), "e", stale_after=60, heartbeat=0.05, poll=0.05)
    assert own.acquire(lambda: False, lambda: None, lambda: False)
    (vault / "e.lock").write_text(json.dumps({"token": "successor"}))
    own.release()
    assert (vault / "e.lock").exists()


def test_heartbeat_keeps_a_lock_fresh(tmp_path):
    from matgraph.operators.files import LocalFiles
    from matgraph.operators.locks import BuildLock

    files = LocalFiles(tmp_path)
    lock = BuildLock(files, "e", stale_after=60, heartbeat=0.05, poll=0.05)
    lock.acquire(lambda: False, lambda: None, lambda: False)
    os.utime(tmp_path / "e.lock", (0, 0))
    time.sleep(0.3)
    assert files.age("e.lock") < 10
    lock.release()
    assert not files.exists("e.lock")


def test_nested_runs(tmp_path):
    @derivation("outer")
    def outer():
        inner = realize(tmp_path / "inner", greeting("nested"), executor=LocalExecutor())
        output().write_text(inner.read_text())

    assert build(tmp_path, outer()).read_text() == "hello nested"


def test_interrupts_end_a_run(tmp_path):
    import signal
    import subprocess
    import sys

    script = tmp_path / "run.py"
    script.write_text(
        "import sys, time\n"
        f"sys.path.insert(0, {os.getcwd()!r})\n"
        "from matgraph import *\n"
        "@derivation('s', pool='p')\ndef s(i):\n    time.sleep(30)\n"
        "@derivation('c', pool='p', isolate=True)\ndef c(i):\n    import time\n    time.sleep(30)\n"
        f"realize({str(tmp_path / 'vault')!r}, Gather(s(1), s(2), c(1), c(2)), executor=LocalExecutor({{'p': 4}}))\n"
    )
    child = subprocess.Popen([sys.executable, str(script)], stderr=subprocess.PIPE)
    time.sleep(3)
    child.send_signal(signal.SIGINT)
    at = time.monotonic()
    child.communicate(timeout=15)
    assert time.monotonic() - at < 5 and child.returncode != 0
    assert not [n for n in os.listdir(tmp_path / "vault") if n.endswith(".lock")]


def test_a_graph_that_can_not_go_on(tmp_path):
    body = lambda _: output().write_text("x")
    a = Derivation("a", b"1", [], body)
    b = Derivation("b", b"2", [a], body)
    a.dependencies.append(b)  # by hand, in a ring
    with pytest.raises(RuntimeError, match="nothing can run"):
        realize(tmp_path / "vault", Gather(b, Derivation("c", b"3", [], body)), executor=LocalExecutor())
    assert [n for n in os.listdir(tmp_path / "vault") if not n.endswith(".lock")] == [f"{b'3'.hex()}-c"]


def test_capacity_of_pools():
    assert LocalExecutor({"p": 3}, default_pool_size=2).capacity("p") == 3 and LocalExecutor({"p": 3}, default_pool_size=2).capacity("q") == 2


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from matgraph.operators.scratch import shared_dir

    conf = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_dir(session("yarn")) == "hdfs:///shared"
    conf.clear()
    assert shared_dir(session("local[4]")).startswith("file:///") and conf
