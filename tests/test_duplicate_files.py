"""Duplicates among files as they lie in the file system: what is found, and what is read for it."""

import os

import pytest

from pathlake.operators import duplicates
from pathlake.sources import walk


@pytest.fixture
def tree(tmp_path):
    def put(name, body):
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
        return p

    k = duplicates.PREFIX
    put("a/short1", b"same bytes")
    put("b/short2", b"same bytes")
    put("alone", b"nothing has this size, or so")
    put("size only", b"same_bytes")
    put("empty1", b"")
    put("empty2", b"")
    put("long1", b"x" * k + b"tail one")
    put("long2", b"x" * k + b"tail two")
    put("long3", b"x" * k + b"tail one")
    put("head1", b"y" * (3 * k))
    put("head2", b"z" * (3 * k))
    os.link(put("linked", b"only hard links"), tmp_path / "t/linked again")
    os.link(tmp_path / "t/long1", tmp_path / "t/long1 again")
    os.symlink(tmp_path / "t/a/short1", tmp_path / "t/soft")
    return tmp_path / "t"


def test_duplicate_files(spark, tree, monkeypatch):
    monkeypatch.setattr(duplicates, "READ", 1000)
    files = walk.walk(spark, walk.WalkOptions([str(tree)]))
    members, reads = duplicates.duplicate_files(files)
    groups = {}
    for r in members.collect():
        groups.setdefault(r["digest"], set()).add(os.path.relpath(r["path"], tree))
    assert sorted(map(sorted, groups.values())) == [["a/short1", "b/short2"], ["long1", "long3"]]
    k, took = duplicates.PREFIX, {}
    for r in reads.collect():
        took.setdefault(r["step"], {})[os.path.relpath(r["path"], tree)] = r["read"]
    assert took["prefix"] == {**dict.fromkeys(("a/short1", "b/short2", "size only"), 10), **dict.fromkeys(("long1", "long2", "long3", "head1", "head2"), k)}
    assert took["whole"] == dict.fromkeys(("long1", "long2", "long3"), k + 8)
    top = duplicates.duplicate_groups(members).first()
    assert (top["n"], top["waste"]) == (2, k + 8)


def test_files_that_change_or_go(spark, tree):
    files = spark.createDataFrame(walk.walk(spark, walk.WalkOptions([str(tree)])).collect(), "path string, size long, mtime long, is_dir boolean")
    (tree / "b/short2").unlink()
    (tree / "long3").write_bytes(b"shorter now")
    members, _ = duplicates.duplicate_files(files)
    assert members.count() == 0 and duplicates.duplicate_files(files.limit(0))[0].count() == 0
