"""Relations over build graphs, and figures as columns, against plain Python."""

import math
import random

import pytest

from matgraph.functions import messages
from matgraph.functions.figures import rounded_column
from matgraph.functions.status import build_json
from matgraph.plans import relations
from matgraph.plans.scheduler import reported
from matgraph.streaming import reporters
from matgraph.streaming.state import BuildState


def plain_blocked(edges, failed):
    blocked: set = set()
    todo = list(failed)
    above: dict = {}
    for node, dep in edges:
        above.setdefault(dep, []).append(node)
    while todo:
        for node in above.get(todo.pop(), ()):
            if node not in blocked and node not in failed:
                blocked.add(node)
                todo.append(node)
    return blocked


def closure(spark, edges, failed):
    got = [r["node"] for r in relations.blocked_closure(spark.createDataFrame(edges, "node long, dep long"), spark.createDataFrame([(x,) for x in failed], "node long")).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_a_long_chain_takes_few_jobs(spark):
    """10,000 levels: the tables written are as many as the logarithm says."""
    written = []
    keep = relations._written
    relations._written = lambda df, folder, name: written.append(name) or keep(df, folder, name)
    try:
        assert closure(spark, [(k, k - 1) for k in range(1, 10_001)], [3]) == set(range(4, 10_001))
    finally:
        relations._written = keep
    assert len(written) < 12


@pytest.mark.parametrize("seed", range(6))
def test_blocked_against_plain_search(spark, seed):
    rng = random.Random(seed)
    n = 120
    edges = [(k, rng.randrange(max(0, k - rng.choice([2, 9, 120])), k)) for k in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    edges += [(n + k, n + (k + 1) % 5) for k in range(5)]  # a ring, out of reach
    failed = rng.sample(range(n), 6) + [7, 7]
    assert closure(spark, edges, failed) == plain_blocked(edges, set(failed))


def test_blocked_of_rings_and_nothing(spark):
    assert closure(spark, [(1, 2), (2, 1), (3, 2), (4, 4), (5, 4)], [2]) == {1, 3}
    assert closure(spark, [(1, 2)], []) == set() and closure(spark, [], [1]) == set()
    assert closure(spark, [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (4, 1)], [0]) == {1, 2, 3, 4}


def numbers():
    rng = random.Random(4)
    out = [k / 20 for k in range(-3000, 3000)] + [rng.randrange(1 << 22) / 2 ** rng.randrange(12) for _ in range(3000)] + [rng.uniform(0, 1) for _ in range(2000)]
    return out + [k / 8 + 1.7e9 for k in range(200)] + [1e15 + 0.5, 1e300, -1e300, 0.0, -0.0, -0.01, 5e-324, 2.675, 0.15, 0.25, float("inf")]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rounding_of_ten_thousand_numbers(spark, digits):
    rows = spark.createDataFrame([(x,) for x in numbers()], "x double").select("x", rounded_column(spark_col("x"), digits).alias("r")).collect()
    for r in rows:
        want = round(r["x"], digits)
        assert r["r"] == want and math.copysign(1, r["r"]) == math.copysign(1, want), (r["x"], r["r"], want)
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(rounded_column(spark_col("x"), 1)).collect()[0][0] is None


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_builds_as_documents_in_both_forms(spark, monkeypatch):
    """The JSON of columns has the fields and values of the driver's."""
    import json

    from pyspark.sql import functions as F

    rng = random.Random(9)
    now = 1_700_000_100.0
    monkeypatch.setattr("time.time", lambda: now)
    builds = []
    for k in range(2000):
        started = now - rng.choice([0.25, 0.15, 2.5, 1e5 + 0.05, rng.randrange(4000) / 20])
        done, total = rng.choice([(1.0, 32.0), (3.0, 0.0), (None, 5.0), (float(k % 7), 8.0), (k / 16, 625.0)])
        builds.append(BuildState(f"l{k:04d}", "n", "p", 1, "running", rng.choice([started, started, None]), rng.choice([None, started + k / 20]), done, total, rng.choice(["", "a\"b"]), ""))
    schema = "label string, name string, pool string, slots int, status string, started_at double, finished_at double, done double, total double, text string, error string"
    rows = spark.createDataFrame([tuple(vars(b).values()) for b in builds], schema)
    got = {r["label"]: json.loads(r["b"]) for r in rows.select("label", build_json(F.lit(now)).alias("b")).collect()}
    assert got == {b.label: reporters.build_json(b) for b in builds}


def test_numbers_of_messages_in_both_forms(spark):
    values = ["1", "x", "", " 2.5 ", "1_0", "_1", "1__0", "1e3", ".5", "5.", "inf", "-Infinity", "nan", "1d", "0x1", "1e", "+3", "é"]
    said = [{k: v for k, v in (("DONE", d), ("TOTAL", t), ("STATUS", s)) if v is not None} for d in [*values, None] for t in [*values, None] for s in ("text", None)]
    assert reported({"DONE": "bad", "TOTAL": "7", "STATUS": "s"}) == {"text": "s"} and reported({"DONE": "2", "TOTAL": "bad"}) == {"done": 2.0}
    rows = spark.createDataFrame(list(enumerate(said)), "n int, fields map<string, string>").select("n", messages.reported(spark_col("fields")).alias("r"))
    for r in rows.collect():
        want = reported(said[r["n"]])
        assert repr([r["r"][k] for k in ("done", "total", "text")]) == repr([want.get(k) for k in ("done", "total", "text")]), said[r["n"]]
