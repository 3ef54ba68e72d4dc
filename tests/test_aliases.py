"""Aliases of datasets: no files of their own, resolved on read, kept while pointed at."""

import os
import time
from pathlib import Path

import pytest

import matgraph as m
from matgraph.operators import aliases
from matgraph.operators.files import HadoopFiles, LocalFiles, complete, manifest_of
from matgraph.plans.nodes import label_of


@m.derivation("numbers")
def numbers(n):
    return m.session().range(n)


@m.derivation("halved")
def halved(rows):
    return rows.filter("id % 2 = 0")


def build(root, node, **kw):
    return m.realize(str(root), node, executor=m.LocalExecutor(default_pool_size=2), **kw)


def parquet_below(path):
    return [f for f in Path(path).rglob("*.parquet")]


@pytest.fixture(params=["local", "hadoop"])
def vault(request, spark, tmp_path):
    root = tmp_path / "vault"
    return (LocalFiles(root), root) if request.param == "local" else (HadoopFiles(f"file://{root}", spark), root)


def test_aliases_hold_no_files(spark, tmp_path):
    source = numbers(10)
    link, renamed = m.Symlink("link", source), m.Rename("renamed", m.Symlink("link", source))
    a, b, c = build(tmp_path, m.Gather(link, renamed, halved(renamed)))
    assert a.count() == b.count() == 10 and c.count() == 5
    files = LocalFiles(tmp_path)
    target = label_of(source)
    for node in (link, renamed):
        assert not parquet_below(tmp_path / label_of(node)) and manifest_of(files, label_of(node))["alias_of"] == target
        assert manifest_of(files, label_of(node))["rows"] == 10 and complete(files, label_of(node))
    assert aliases.references(files, target) == sorted(map(label_of, (link, renamed)))
    assert a.matgraph_uri == files.uri(target) and build(tmp_path, link).count() == 10
    # Partitions of an alias are those of its target.
    assert spark.read.parquet(files.uri(target)).count() == 10


def test_a_dataset_of_another_vault_is_published_again(spark, tmp_path):
    other = build(tmp_path / "other", numbers(4))

    @m.expression()
    def there():
        return other

    node = m.Rename("copied", there())
    assert build(tmp_path / "own", node).count() == 4
    assert parquet_below(tmp_path / "own" / label_of(node)) and manifest_of(LocalFiles(tmp_path / "own"), label_of(node))["rows"] == 4


def test_targets_stay_while_pointed_at(spark, vault, tmp_path):
    files, root = vault
    source = numbers(6)
    links = [m.Symlink(f"link{k}", source) for k in range(3)]
    build(root, m.Gather(*links))
    target, names = label_of(source), [label_of(x) for x in links]
    assert not aliases.forget(files, target) and complete(files, target) and build(root, links[0]).count() == 6
    assert aliases.forget(files, names[0]) and complete(files, target) and not files.exists(names[0])
    assert aliases.forget(files, names[1]) and build(root, links[2]).count() == 6
    assert aliases.forget(files, names[2]) and not files.exists(target)
    assert build(root, links[0]).count() == 6  # built again


def test_an_alias_whose_target_is_gone_is_built_again(spark, tmp_path):
    source = numbers(3)
    link = m.Symlink("link", source)
    build(tmp_path, link)
    files = LocalFiles(tmp_path)
    files.remove(label_of(source))
    assert not complete(files, label_of(link))
    assert build(tmp_path, link).count() == 3 and complete(files, label_of(source))


def test_references_of_aliases_that_never_came(spark, tmp_path):
    source = numbers(3)
    build(tmp_path, source)
    files, target = LocalFiles(tmp_path), label_of(source)
    aliases.refer(files, "0-new", target)
    assert aliases.references(files, target) == ["0-new"]
    old = time.time() - aliases.PENDING - 1
    os.utime(tmp_path / target / aliases.REFERENCES / "0-new", (old, old))
    assert aliases.references(files, target) == [] and aliases.forget(files, target) and not files.exists(target)
