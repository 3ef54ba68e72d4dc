"""The progress channel, reports and derived figures."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from matgraph import (
    BuildState,
    Gather,
    LocalExecutor,
    LogReporter,
    MultiReporter,
    RealizeError,
    Reporter,
    Snapshot,
    TextReporter,
    build_env,
    derivation,
    output,
    progress,
    realize,
)
from matgraph.functions import messages, status
from matgraph.plans import relations
from matgraph.streaming.progress import ProgressHandle, ProgressServer, bound, parse_message
from matgraph.streaming.reporters import build_json, status_document, table_of
from matgraph.streaming.state import STATUSES, fmt_elapsed

MESSAGES = [b"ID=abc-x\nDONE=3\nTOTAL=10\nSTATUS=hello=world\n", b" K =v \nno sign\nK=w\nID=1\nID=2", b"", b"=x\nID=", b"\xff=1\nID=q"]


class Recorder(Reporter):
    def __init__(self):
        self.seen, self.closed = [], None

    def update(self, snapshot):
        self.seen.append(snapshot)

    def close(self, snapshot):
        self.closed = snapshot


def run(tmp_path, node, reporter=None, **kw):
    return realize(tmp_path / "vault", node, executor=LocalExecutor(default_pool_size=4, poll=0.05), reporter=reporter, **kw)


def test_messages_as_bytes_and_columns(spark):
    assert parse_message(MESSAGES[0]) == ("abc-x", {"DONE": "3", "TOTAL": "10", "STATUS": "hello=world"})
    assert parse_message(MESSAGES[1]) == ("2", {"K": "w"}) and parse_message(b"") == (None, {})
    rows = spark.createDataFrame([(i, m.decode("utf-8", "replace")) for i, m in enumerate(MESSAGES)], "i int, m string")
    got = {r["i"]: (r["p"]["id"], r["p"]["fields"]) for r in rows.select("i", messages.parse_message(F.col("m")).alias("p")).collect()}
    assert got == {i: parse_message(m) for i, m in enumerate(MESSAGES)}


def test_channel_coalesces_and_never_fails():
    got = []
    server = ProgressServer(lambda build, fields: got.append((build, fields)))
    handle = ProgressHandle(server.name, "b")
    handle.total(100)
    for i in range(100):
        handle.set(i)
    handle.status("two\nlines")
    handle.status("two\nlines")
    time.sleep(0.4)
    assert len(got) == 2 and got[-1] == ("b", {"DONE": "99", "TOTAL": "100", "STATUS": "two lines"})
    server.close()
    for i in range(5):
        handle.status(f"nobody listens {i}")
    idle = progress()
    idle.total(1), idle.set(1), idle.status("x")
    assert not idle.active


def test_environment():
    assert "MATGRAPH_BUILD" not in build_env()
    with bound(("127.0.0.1:9", "b")):
        assert build_env()["MATGRAPH_BUILD"] == "b" and progress().active


def test_progress_of_threads_children_and_scripts(tmp_path):
    @derivation("in-thread")
    def body():
        p = progress()
        p.total(10), p.set(4), p.status("working")
        time.sleep(0.3)
        output().write_text("x")

    @derivation("isolated", isolate=True)
    def child():
        p = progress()
        p.total(7), p.status("in the child")
        output().write_text("x")

    @derivation("script")
    def script():
        code = f"import sys; sys.path.insert(0, {os.getcwd()!r}); from matgraph import progress; progress().status('from a script')"
        subprocess.run([sys.executable, "-c", code], env=build_env(), check=True)
        time.sleep(0.2)
        output().write_text("x")

    seen = Recorder()
    run(tmp_path, Gather(body(), child(), script()), seen)
    last = {b.name: b for b in seen.closed.builds.values()}
    assert (last["in-thread"].total, last["in-thread"].text) == (10, "working") and last["isolated"].total == 7
    assert last["isolated"].text == "in the child" and last["script"].text == "from a script"
    assert {b.status for b in last.values()} == {"done"} and last["in-thread"].elapsed >= 0.3


def test_transitions_and_ticks(tmp_path):
    @derivation("quiet")
    def quiet():
        time.sleep(2.6)
        output().write_text("x")

    seen = Recorder()
    run(tmp_path, quiet(), seen)
    assert len([s for s in seen.seen if s.count("running")]) >= 3
    seen = Recorder()
    run(tmp_path, quiet(), seen)
    assert seen.closed.counts() == dict.fromkeys(STATUSES, 0) | {"cached": 1}


def test_waiting_is_reported(tmp_path):
    from matgraph.plans.nodes import label_of

    @derivation("w")
    def w():
        output().write_text("x")

    (tmp_path / "vault").mkdir()
    lock = tmp_path / "vault" / f"{label_of(w())}.lock"
    lock.write_text("{}")
    import threading

    threading.Timer(0.5, lock.unlink).start()
    seen = Recorder()
    run(tmp_path, w(), seen)
    assert any(s.count("waiting") for s in seen.seen) and seen.closed.count("done") == 1


def test_log_status_file_and_faulty_reporters(tmp_path):
    @derivation("a")
    def a():
        output().write_text("x")

    @derivation("b", slots=2)
    def b():
        raise ValueError("first line\nboom")

    @derivation("c")
    def c(b):
        pass

    class Faulty(Reporter):
        def update(self, snapshot):
            raise RuntimeError("reporter")

        close = update

    log = LogReporter(tmp_path / "log", tmp_path / "deep" / "status", period=0)
    with pytest.raises(RealizeError):
        run(tmp_path, Gather(a(), c(b())), MultiReporter(Faulty(), log, TextReporter(stream=open(os.devnull, "w"))))
    with pytest.raises(RealizeError):
        run(tmp_path, c(b()), Faulty())
    lines = [line[9:] for line in (tmp_path / "log").read_text().splitlines()]
    assert lines[0].startswith("start    3 nodes  pending 3") and lines[-1].startswith("end      done 1  cached 0")
    assert any(x.startswith("done     a  pool=default elapsed=0:0") for x in lines)
    assert any(x.startswith("failed   b  pool=default x2 elapsed=0:0") and x.endswith("error=boom") for x in lines)
    assert "blocked  c  pool=default" in lines and not any(x.startswith("pending") for x in lines)
    doc = json.loads((tmp_path / "deep" / "status").read_text())
    assert doc["counts"]["failed"] == 1 and doc["blocked"] == ["c"] and "boom" in doc["failed"][0]["error"]


def states():
    now = time.time()
    rows = [
        BuildState("x", "x", "p", status="done", started_at=now - 100, finished_at=now - 50),
        BuildState("y", "y", "p", 2, "running", started_at=now - 20, done=1, total=4, text="t"),
        BuildState("z", "z", "p"),
        BuildState("w", "w", "q", status="waiting"),
        BuildState("f", "f", "q", status="failed", started_at=now - 7500, finished_at=now, error="a\nb \n"),
    ]
    return now, Snapshot(now - 120, {b.label: b for b in rows})


def test_figures():
    now, snap = states()
    assert abs(snap.builds["y"].eta - 60) < 1 and snap.builds["z"].eta is None and snap.builds["y"].fraction == 0.25
    assert abs(snap.eta() - 75) < 1 and "~1:1" in snap.summary() and Snapshot(now).eta() is None
    assert [fmt_elapsed(x) for x in (None, 0, 59.9, 245, 3600, 8100)] == ["--", "0:00", "0:59", "4:05", "1h00m", "2h15m"]
    text = table_of(snap)
    assert "y      p x2" in text and "#####..............." in text and "waiting for lock" in text


def test_figures_as_columns(spark):
    now, snap = states()
    frame, at = snap.frame(spark), F.lit(now)
    got = {r["label"]: r for r in frame.select("label", status.elapsed(at).alias("e"), status.fraction().alias("f"), status.build_eta(at).alias("eta")).collect()}
    for label, b in snap.builds.items():
        for name, want in (("e", b.elapsed), ("f", b.fraction), ("eta", b.eta)):
            assert (got[label][name] is None) == (want is None) and (want is None or abs(got[label][name] - want) < 20)
    assert {r["status"]: r["n"] for r in status.status_counts(frame).collect()} == snap.counts()
    row = status.snapshot(frame, at, F.lit(snap.started_at)).first()
    assert abs(row["eta_s"] - snap.eta()) < 20 and row["summary"].split("  elapsed")[0] == snap.summary().split("  elapsed")[0]
    assert [r["label"] for r in status.running_list(frame).orderBy("place").collect()] == ["w", "y"]
    lines = {r["label"]: r["line"] for r in status.log_lines(frame, at).collect()}
    assert lines["f"] == "failed   f  pool=q elapsed=2h05m  error=b" and lines["y"] == "running  y  pool=p x2" and "z" not in lines
    doc = json.loads(status.status_json(frame, at, F.lit(snap.started_at)).first()["document"])
    want = status_document(snap)
    assert doc["counts"] == want["counts"] and doc["pending"] == want["pending"] and [b["label"] for b in doc["running"]] == ["w", "y"]
    assert doc["failed"][0]["error"] == "a\nb \n" and "text" not in doc["failed"][0] and "eta_s" not in build_json(snap.builds["z"])
    empty = Snapshot(now).frame(spark)
    assert {r["n"] for r in status.status_counts(empty).collect()} == {0}
    assert json.loads(status.status_json(empty, at, at).first()["document"])["running"] == []


def test_graph_relations(spark):
    diamond = spark.createDataFrame([("l", "base"), ("r", "base"), ("top", "l"), ("top", "r"), ("x", "y")], "node string, dep string")
    failed = spark.createDataFrame([("base",)], "node string")
    assert sorted(r["node"] for r in relations.blocked_closure(diamond, failed).collect()) == ["l", "r", "top"]
    deep = spark.createDataFrame([(i + 1, i) for i in range(12)], "node long, dep long")
    assert relations.blocked_closure(deep, spark.createDataFrame([(3,)], "node long")).count() == 9
    nodes = spark.createDataFrame([(n,) for n in ("base", "l", "r", "top", "x", "y")], "node string")
    assert sorted(r["node"] for r in relations.ready_set(nodes, diamond, failed).collect()) == ["l", "r", "y"]


def plain_admission(rows, budget):
    out, used = [], {}
    for node, pool, slots in sorted(rows):
        if used.get(pool, 0) + slots <= budget:
            used[pool] = used.get(pool, 0) + slots
            out.append((node, pool, slots))
    return out


def test_admission_against_the_plain_fold(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"p{rng.randrange(3)}", rng.randrange(1, 12)) for i in range(300)]
    got = relations.slot_admission(spark.createDataFrame(rows, "node long, pool string, slots int"), 10)
    assert sorted(map(tuple, got.collect())) == plain_admission(rows, 10)


def test_run_graph_as_frames(spark):
    from matgraph import Constant
    from matgraph.plans.scheduler import Graph

    nodes, edges = Graph(Gather(Constant(1), Constant(1), Constant(2))).frames(spark)
    assert nodes.count() == 3 and edges.count() == 3
