import numpy as np
import pytest
from pyspark.sql import functions as F

from matgraph.llm import permutation_index as P


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[ids.index(i)]
        scores = sorted((-float((v * q).sum()), j) for j, v in zip(ids, x) if j != i)
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_and_exact_scores(spark, monkeypatch, lengths):
    monkeypatch.setattr(P, "BLOCK", 1500)
    monkeypatch.setattr(P, "LEAST", 60)
    monkeypatch.setattr(P, "PIVOTS", 256)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= rng.uniform(0.5, 2, (4000, 1))
    ids = list(range(4000))
    got = P.nearest(table(spark, list(zip(ids, x.tolist()))), F.col("vec_id") % 100 == 0, 10).collect()
    want = brute(ids, x, range(0, 4000, 100), 10)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert np.isclose(r["score"], x[r["vec_id"]] @ x[r["query_id"]], rtol=1e-12)
    assert all(len(v) == 10 for v in found.values()) and len(found) == 40
    assert np.mean([len({j for j, _ in found[q]} & {j for j, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_ties_odd_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50, 0, -1)] + [(60, [0.0, 0.0]), (61, None), (62, [None, 1.0]), (63, [float("nan"), 1.0]), (64, [float("inf"), 0.0]), (None, [1.0, 0.0]), (65, [1.0, 2.0, 3.0]), (66, []), (20, [1.0, 0.0])]
    got = P.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(q, n, n, 1.0) for q in (20, 40) for n in range(1, 6)]
    assert P.nearest(table(spark, []), F.lit(True)).count() == 0
    assert P.nearest(table(spark, [(20, [1.0, 0.0])]), F.lit(True)).count() == 0


def test_copies_beyond_the_candidates(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST", 30)
    monkeypatch.setattr(P, "SHARE", 0.0)
    rng = np.random.default_rng(2)
    rows = [(i, [3.0, 1.0, 0.5]) for i in range(1, 400)] + [(1000 + i, v) for i, v in enumerate(rng.normal(size=(600, 3)).tolist())]
    got = P.nearest(table(spark, rows), F.col("vec_id").isin(100, 7), 8).orderBy("query_id", "rank").collect()
    best = {q: [r["vec_id"] for r in got if r["query_id"] == q and abs(r["score"] - 10.25) < 1e-9] for q in (7, 100)}
    assert best[100] == sorted(best[100]) and best[7] == sorted(best[7]) and len(best[7]) + len(best[100]) > 0


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(3)
    rows = [(1, [1.0, 0.5])] * 40 + [(20, [1.0, 0.0])] * 3 + [(100 + i, v) for i, v in enumerate(rng.normal(size=(26, 2)).tolist())]
    got = P.nearest(table(spark, rows), F.col("vec_id") == 20, 20).orderBy("rank").collect()
    best = sorted(((-v[0], i) for i, v in dict(rows).items() if i != 20))[:20]
    assert [(r["rank"], r["vec_id"]) for r in got] == [(n + 1, i) for n, (_, i) in enumerate(best)]
    two = [(1, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [1.0, 0.0]), (2, [0.7, 0.0])]
    got = P.nearest(table(spark, two), F.col("vec_id") == 20, 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 0.7), (1, 0.5)]
