"""The audit against a plain count in Python's own integers."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from matgraph.llm import divergence
from matgraph.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_docs=3, top=200):
    used: dict = {}
    frequency: dict = {}
    for text, lang, source in docs:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        used.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        frequency.setdefault(lang or "", Counter()).update(set(terms))
    out = []
    for lang, groups in used.items():
        kept = [t for t, n in frequency[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        whole = share(sum(groups.values(), Counter()))
        value = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(-sum(value(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-value(p[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > whole[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)]
    return sorted(out)


def found(rows):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = ["the", "The", "THE", "été", "Été", "straße", "漢字", "a", "z1y", "don't", "x-y", "\u0085", " ", "𝒳", "", "Z"] + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    out = [(" ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "fr"]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}") for _ in range(400)]
    out += [("the the", None, None), (None, "en", "bare"), ("", "xx", "p"), (None, None, "q"), ("one two", "xx", "r"), ("1 2 3 _", "en", ""), ("q" * 100_000, "en", "hot")]
    out += [("tie alpha beta gamma", "tt", s) for s in "abab"] + [("the " * 600_000 + "big", "en", "long")] * 3
    return out


def frame(spark, docs):
    return spark.createDataFrame([(None if k % 7 == 0 else k % 50, *d, "own", 1) for k, d in enumerate(docs)], SCHEMA).repartition(5)


def test_audit_equals_plain_counting(spark, docs):
    assert found(divergence.audit(frame(spark, docs)).collect()) == plain(docs)


def test_bounds_change_nothing(spark, docs, monkeypatch):
    """Many hand-overs, chunks of few rows and dense vectors of few terms give the same rows."""
    monkeypatch.setattr(divergence, "ROWS", 50)
    small = docs[:120]
    held = divergence._counted

    def counted(batches):
        divergence.FLUSH = 20
        return held(batches)

    monkeypatch.setattr(divergence, "_counted", counted)
    assert found(divergence.audit(frame(spark, small)).collect()) == plain(small)
    table = pa.table({"term": ["b", "a", "c", "a"], "source": ["x", "x", "y", "y"], "n": [3, 1, 2, 7]})
    groups = pa.table({"source": ["y", "x", "z"], "total": [9, 4, 0], "kept": [3, 3, 3]})
    one = divergence._chunk((pa.scalar("en"),), table, groups)
    monkeypatch.setattr(divergence, "CELLS", 1)
    assert divergence._chunk((pa.scalar("en"),), table, groups).equals(one) and one.num_rows > 6


def test_query_equals_sql_on_odd_rows(spark, docs, tmp_path):
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op11_divergence"])
    names = [d[0] for d in want.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in want.fetchall())
    assert found(QUERIES["op11_divergence"](spark, str(tmp_path)).collect()) == want


def test_shares_of_huge_counts():
    counts = [0, 1, 10**9, 10**12, 8 * 10**12, 9 * 10**12 - 1]
    for total in (9 * 10**12, 9 * 10**12 + 7):
        assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]
    assert divergence.shares(np.array([0]), 1).tolist() == [1 + 10**9]


def test_empty_table_and_no_terms(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [("a b", "en", "x"), ("a", "en", "y"), (None, "fr", "z")]
    assert found(divergence.audit(frame(spark, docs)).collect()) == plain(docs) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
