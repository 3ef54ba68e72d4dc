import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from matgraph.llm import _rows, exact_dedup, simhash
from matgraph.llm._graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash") for i, t in texts], SCHEMA)


def test_exact_dedup_against_brute_force(spark):
    texts = [(i, f"common  {'x' if i % 9 else ' '}text") for i in range(400)]
    texts += [(1000 + i, f"word {i % 50}") for i in range(120)]
    texts += [(2000, None), (2001, ""), (2002, " \t\n\v\f\r"), (2003, "wo rd 7"), (2004, " "), (2005, "y" * 300_000), (2006, "y" * 299_999 + " y")]
    got = {r["doc_id"]: r for r in exact_dedup.membership(docs(spark, texts), k=8, min_heavy=10).collect()}
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(texts)
    for key, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(rows), i == keep)
            assert got[i]["digest"] == hashlib.sha256(key.encode()).digest()
    kept = exact_dedup.drop_copies(docs(spark, texts))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and kept.count() == len(groups)


def test_exact_dedup_of_odd_rows(spark):
    got = exact_dedup.membership(docs(spark, [(None, "a"), (None, "b"), (5, "a"), (3, "c"), (3, "c")])).collect()
    assert sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == [
        ('3', 3, 2, True), ('3', 3, 2, True), ('5', 5, 2, True), ('None', 5, 2, False), ('None', None, 1, True)]
    assert exact_dedup.membership(docs(spark, [])).collect() == []


def test_misra_gries_keeps_every_frequent_value(spark):
    rows = spark.createDataFrame([(bytes([v % 251]) if v % 3 else b"hot",) for v in range(3000)], "d binary").repartition(7)
    found = {r["digest"]: r["at_least"] for r in exact_dedup.misra_gries(rows, "d", 4).collect()}
    assert 1000 - 3000 / 5 <= found[b"hot"] <= 1000


ODD = [
    (1, "alpha beta"), (5, "alpha beta"), (5, "quite another text"), (7, "z z"), (7, "z z"), (7, "z  z"), (None, "z z"),
    (None, "only without an id"), (None, "only without an id"), (None, "its own"), (9, None), (9, ""), (8, " "), (None, None),
]


def texts_of(rows):
    return sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=repr)


@pytest.mark.parametrize("broadcast", [_rows.BROADCAST_ROWS, 0])
def test_one_row_of_each_group_stays(spark, monkeypatch, broadcast):
    monkeypatch.setattr(_rows, "BROADCAST_ROWS", broadcast)
    given = docs(spark, ODD)
    want = [(1, "alpha beta"), (5, "quite another text"), (7, "z  z"), (None, "only without an id"), (None, "its own"), (8, " ")]
    assert texts_of(exact_dedup.drop_copies(given)) == sorted(want, key=repr)
    kept = texts_of(simhash.keep_one(given))
    # To SimHash all spaces are alike, and of one id's texts either may stay.
    assert [(i, " ".join(t.split())) for i, t in kept] == sorted(((i, " ".join(t.split())) for i, t in want), key=repr)
    for f in (exact_dedup.drop_copies, simhash.keep_one):
        assert f(given).columns == given.columns and texts_of(f(given.repartition(3))) == texts_of(f(given)) and f(given.limit(0)).count() == 0
        many = docs(spark, [(4, "same row")] * 300 + [(None, "same row")] * 300)
        assert texts_of(f(many)) == [(4, "same row")]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 6])
def test_simhash_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    rng = np.random.default_rng(3)
    vocabulary = [f"W{i}" for i in range(300)]
    texts = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one two"), (5, "ONE TWO"), (6, "é É é")]
    for base in range(40):
        words = list(rng.choice(vocabulary, 200))
        for copy in range(int(rng.integers(1, 5))):
            changed = list(words)
            changed[int(rng.integers(200))] = "edit"
            texts.append((100 * base + 10 + copy, "  ".join(changed if copy else words)))
    texts.append((9999, " ".join(rng.choice(vocabulary, 90_000))))
    prints = {i: plain_fingerprint(t) for i, t in texts}
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.membership(docs(spark, texts)).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(texts) - 20
    kept = simhash.keep_one(docs(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_of_odd_rows(spark):
    got = simhash.membership(docs(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "x y z w")])).collect()
    assert len(got) == 4 and {r["component_id"] for r in got if r["doc_id"] == 7} == {7}
    texts = [(3, "a b c"), (5, "a b c"), (5, "another text with words"), (6, "another text with words"), (None, "x y z w")]
    got = simhash.membership(docs(spark, texts)).collect()  # an id of two texts joins nothing
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("5", "3"), ("5", "5"), ("6", "5"), ("None", "None")]
    assert simhash.membership(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), min_size=2, max_size=60, unique=True), st.integers(0, 53))
def test_trie_pairs_are_exact(values, shift):
    v = np.sort(np.array(values, np.uint64) << np.uint64(shift))
    a, b = simhash.trie_pairs(v, np.zeros(len(v)))
    got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist()))
    assert got == [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2]


def test_words_survive_block_borders():
    text = b" ".join(b"w%d" % i for i in range(1000)) * 3
    assert list(itertools.chain(*simhash.shingle_hashes(text))) == [
        xxhash.xxh64_intdigest(b" ".join(w), 42) for w in zip(text.split(), text.split()[1:], text.split()[2:])]
    from matgraph.llm._base import word_blocks

    assert [w for block in word_blocks(text, 37) for w in block] == text.split()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(1000, 1100)] + [(3, 7), (3, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{j: 3 for j in range(1000, 1100)}, 7: 3}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
