"""Runs against every period and place of small texts, and the query against its SQL."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matgraph.llm import periodic_runs
from matgraph.llm.queries import ORACLE, QUERIES, with_repeats

SCHEMA = "doc_id long, text string, runs string, start long"


def plain(words, exponent=3, least=24):
    out, seen = [], set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q) and (i, j) not in seen and not any(s == i and n == j - i + q for s, n, _ in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


repeated = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.integers(0, 60)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(repeated)
def test_runs_equal_brute_force(parts):
    words = [w for unit, times, cut in parts for w in (unit * times)[: cut or None]]
    assert periodic_runs.runs_of(np.array(words, np.int32)) == plain(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80), st.sampled_from([(2, 2), (2, 6), (4, 8)]))
def test_runs_of_other_bounds(words, bounds):
    assert periodic_runs.runs_of(np.array(words, np.int32), *bounds) == plain(words, *bounds)


def test_blocks_of_sets_and_words_of_which_nothing_repeats():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    words = [ord(c) for c in b] + [1000 + k for k in range(500)] + list(range(700)) * 3 + [5] * 4000
    assert periodic_runs.BLOCK < 1000
    assert periodic_runs.runs_of(np.array(words, np.int32)) == plain(words)


def test_memory_of_a_long_repetition():
    """Three rounds of 200,000 words, and one word 600,000 times."""
    for words, want in ((list(range(200_000)) * 3, (0, 600_000, 200_000)), ([0] * 600_000, (0, 600_000, 1))):
        assert periodic_runs.runs_of(np.array(words, np.int32)) == [want]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    tens = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    text = lambda n, k: rng.choice(["", " "]) + rng.choice([" ", "\n", "\t \r\n"]).join(f"w{rng.randrange(k)}" for _ in range(n))
    out = [(i, text(rng.randrange(1, 300), 50)) for i in tens] + [(i, None) for i in tens[:2]] + [(tens[3], " \n")]
    out += [(None, "a b " * 40), (None, "a b " * 40), (5, None), (6, ""), (7, "   "), (8, "x" * 2_000_000), (8, "é é " * 9 + "ü " * 30)]
    out += [(k, text(60, 2)) for k in range(1000, 1040)] + [(9, "- " * 100_000 + "end"), (11, ("one two three four " * 9 + "five ") * 4)]
    return out


def test_query_equals_sql_and_plain_rewriting(spark, rows, tmp_path):
    small = [r for r in rows if len(r[1] or "") < 10_000]
    for name, own in (("all", rows), ("small", small)):
        spark.createDataFrame([(*r, "own", 1) for r in own], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/all")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/small/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op13_periodic_runs"])
    columns = [d[0] for d in want.description]
    of_small = QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/small").select(*columns).collect()
    assert sorted(map(repr, map(tuple, of_small))) == sorted(map(repr, want.fetchall()))
    assert got.count() == len(rows)
    long = next(r for r in got.collect() if r["doc_id"] == 9)
    assert (long["start"], long["length"], long["period"], long["exponent_milli"]) == (0, 100_000, 1, 10**8)


def test_collapsed_texts_and_runs(spark, rows):
    got = periodic_runs.collapse(spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)).collect()
    have = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr)
    want = []
    for i, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = plain(words) if len(words) < 10_000 else [(0, 100_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert have == sorted(want, key=repr)


def test_rewriting():
    for i in range(300):
        h, n = zlib.crc32(str(i).encode()), 1 + i * 7 % 90
        places = with_repeats(i, n)
        if h % 10:
            assert places is None
        else:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            assert places.tolist() == [k if k < a else a + (k - a) % p for k in range(n)]
    assert with_repeats(None, 5) is None and with_repeats(3, 0) is None


def test_empty_table(spark):
    assert periodic_runs.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
