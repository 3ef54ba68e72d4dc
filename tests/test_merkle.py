"""Folder-by-folder digests against plain recursion, and after changes."""

import hashlib
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from matgraph.functions import merkle
from matgraph.queries import ORACLE, QUERIES

SCHEMA = "root string, path string, content string, digest string, name string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folded(lines, fan):
    """Of (name, line) pairs: in buckets of hex digits, two at a time, then in the order of names."""
    n = len(lines)
    digits = math.ceil(math.log(n / fan, 16)) if n > fan else 0
    rows = [(sha(name)[:digits], name, line) for name, line in lines]
    while digits:
        held = {}
        for key, name, line in rows:
            held.setdefault(key, []).append((name, line))
        rows = [(key[: max(0, digits - 2)], key, f"b {sha(chr(10).join(x for _, x in sorted(own)))} {key}") for key, own in held.items()]
        digits = max(0, digits - 2)
    return sha("\n".join(line for _, _, line in sorted(rows, key=lambda r: r[1])))


def plain(files, fan):
    """{folder or file: digest} of {path: content}."""
    out = {p: sha(c or "") for p, c in files.items()}
    kinds = dict.fromkeys(files, "f")
    folders = {""} | {"/".join(p.split("/")[:k]) for p in files for k in range(1, p.count("/") + 1)}
    for f in sorted(folders, key=lambda f: -(f.count("/") + (f != ""))):
        parent = lambda p: p.rpartition("/")[0]
        own = [p for p in out if p != f and parent(p) == f and p != ""]
        out[f] = folded([(p.rpartition("/")[2], f"{kinds[p]} {out[p]} {p.rpartition('/')[2]}") for p in own], fan)
        kinds[f] = "d"
    return out


def frame(spark, trees):
    return spark.createDataFrame([(r, p, c, "own", "own") for r, files in trees.items() for p, c in files.items()], SCHEMA).select("root", "path", "content", "digest", "name")


def digests(nodes):
    out = {}
    for r in nodes.collect():
        assert (r["root"], r["path"]) not in out
        out[r["root"], r["path"]] = r["digest"]
    return out


def some_files(rng, n):
    names = ["a", "b", "c.txt", "é", "a b", "0"]
    paths = {"/".join(rng.choice(names) + str(rng.randrange(3)) for k in range(last + 1)) for last in (rng.randrange(4) for _ in range(n))}
    # A path that is a folder of another one is no file.
    return {p: rng.choice([None, "", "x", "é\n", "y" * 50]) for p in paths if not any(q.startswith(p + "/") for q in paths)}


@pytest.mark.parametrize("fan", [256, 4])
def test_trees_against_plain_recursion(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(fan)
    trees = {"r": some_files(rng, 60), "s": some_files(rng, 3), "t": {"one": "x"}, "u": {f"f{k}": str(k) for k in range(3000 if fan == 4 else 300)}}
    want = {(r, p): d for r, files in trees.items() for p, d in plain(files, fan).items()}
    nodes = merkle.tree(frame(spark, trees))
    assert digests(nodes) == want
    tops = {r["root"]: (r["n_files"], r["digest"]) for r in merkle.roots(nodes).collect()}
    assert tops == {r: (len(f), want[r, ""]) for r, f in trees.items()}


@pytest.mark.parametrize("fan", [256, 4])
def test_changes_equal_a_new_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(7)
    trees = {"r": some_files(rng, 80), "s": {"d/e/one": "x", "d/two": "y"}, "t": {"only/file": "z"}, "u": {f"g/f{k}": str(k) for k in range(40)}}
    nodes = merkle.tree(frame(spark, trees))
    after = {r: dict(f) for r, f in trees.items()}
    changes = [("s", "d/e/one", None, True), ("t", "only/file", None, True), ("u", "g/f7", "new", False), ("u", "h/i/new", "n", False), ("v", "first/of/root", "v", False), ("s", "nothing/there", None, True)]
    for p in rng.sample(sorted(trees["r"]), 6):
        changes.append(("r", p, None, True) if rng.random() < 0.5 else ("r", p, "rewritten", False))
    for r, p, c, removed in changes:
        after.setdefault(r, {}).pop(p, None)
        if not removed:
            after[r][p] = c
    got = merkle.changed(nodes, spark.createDataFrame(changes, "root string, path string, content string, removed boolean"))
    assert digests(got) == {(r, p): d for r, files in after.items() if files for p, d in plain(files, fan).items()}
    again = merkle.changed(got, spark.createDataFrame([("u", "g/f7", "7", False), ("u", "h/i/new", None, True)], "root string, path string, content string, removed boolean"))
    assert {k: d for k, d in digests(again).items() if k[0] == "u"} == {(r, p): d for (r, p), d in digests(nodes).items() if r == "u"}


def test_large_folders_without_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 4)
    trees = {"r": some_files(random.Random(1), 60), "u": {f"g/f{k}": str(k) for k in range(300)}, "s": {f"{k}/{k % 7}": None for k in range(40)}}
    nodes = merkle.tree(frame(spark, trees), buckets=False)
    assert digests(nodes) == {(r, p): d for r, files in trees.items() for p, d in plain(files, math.inf).items()}


def documents_in_many_folders(tmp_path):
    """A source whose language has more than FAN hundreds, and one whose hundred has 100 documents."""
    ids = [*range(0, 100 * (merkle.FAN + 50), 50), *range(10**6, 10**6 + 100)]
    docs = pa.table({"doc_id": ids, "source": ["s" if i < 10**6 else "t" for i in ids], "lang": ["en"] * len(ids), "text": [f"text {i}" for i in ids]})
    pq.write_table(docs, tmp_path / "documents.parquet")
    return str(tmp_path)


def by_sql(name, folder):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
        return sorted(con.execute(ORACLE[name]).fetchall())


def test_merkle_digest_of_more_folders_than_a_bucket_has(spark, tmp_path):
    folder = documents_in_many_folders(tmp_path)
    assert sorted(tuple(r) for r in QUERIES["merkle_digest"](spark, folder).collect()) == by_sql("merkle_digest", folder)


def test_merkle_change_of_more_folders_than_a_bucket_has(spark, tmp_path):
    folder = documents_in_many_folders(tmp_path)
    assert sorted(tuple(r) for r in QUERIES["merkle_change"](spark, folder).collect()) == by_sql("merkle_change", folder)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.tree(none).count() == 0 and merkle.roots(merkle.tree(none)).count() == 0
    nodes = merkle.tree(frame(spark, {"r": {"a/b": "x"}}))
    assert digests(merkle.changed(nodes, spark.createDataFrame([], "root string, path string, content string, removed boolean"))) == digests(nodes)
