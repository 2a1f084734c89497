"""Walks that do less: quick rescans by the times of directories, and conditions that a walk tests itself."""

import io
import os
import time
import zipfile

import pytest

from pathlake.config import Config
from pathlake.engine import Engine
from pathlake.functions import paths
from pathlake.operators import search, trash
from pathlake.plans.query import Query
from pathlake.schema import DELTA
from pathlake.sources import archives, walk


def tree(root, names, text="x"):
    for name in names:
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def old(root, when=1_000_000):
    """All times long ago, so that no directory was changed in the second of a walk."""
    for at, dirs, files in os.walk(root, topdown=False):
        for n in [*files, *dirs]:
            os.utime(os.path.join(at, n), (when, when))
    os.utime(root, (when, when))


@pytest.fixture
def engine(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, [f"d{i}/e{j}/f{k}.txt" for i in range(4) for j in range(3) for k in range(5)] + ["top.md", "d0/.gitignore"])
    old(root)
    return Engine(spark, str(tmp_path / "cat"), Config(roots=[str(root)])).start(), root


def listed(e):
    options, last = e.walk_options(), e.catalog.commit()
    _, dirs = walk.quick_changes(e.catalog.files(), {r: last["roots"].get(r, -1) for r in walk.root_times(options)}, options, last["walked_at"], 1)
    return sorted(os.path.relpath(r["path"], options.roots[0]) for r in dirs.collect())


def state(e):
    return sorted(map(tuple, e.catalog.entries().collect()))


def truth(e):
    return sorted(map(tuple, walk.walk(e.spark, e.walk_options()).collect()))


def test_an_unchanged_tree_is_not_listed(engine):
    e, _ = engine
    before = e.catalog.commit()["commit"]
    assert listed(e) == [] and e.rescan(quick=True) == 0 and state(e) == truth(e)
    assert e.catalog.commit()["changes"] == [] and e.catalog.commit()["commit"] == before + 1  # only that it was looked at


def test_a_quick_rescan_lists_what_changed(engine):
    e, root = engine
    tree(root, ["d1/e1/new.txt", "d2/deep/er/a.txt", "d2/deep/er/b/c.txt"])
    (root / "d0/e2/f3.txt").unlink()
    os.rename(root / "d3/e0", root / "d3/moved")
    (root / "d1/e0/f0.txt").write_text("longer, in place")
    assert listed(e) == ["d0/e2", "d1/e1", "d2", "d3"]
    assert e.rescan(quick=True) > 0
    here = {os.path.relpath(r[0], root): r for r in state(e)}
    want = {os.path.relpath(r[0], root): r for r in truth(e)}
    assert set(here) == set(want) and {p for p in want if here[p] != want[p]} == {"d1/e0/f0.txt"}
    assert e.rescan() == 1 and state(e) == truth(e) and e.rescan(quick=True) == 0
    ids = [r["id"] for r in e.catalog.files().collect()]
    assert len(ids) == len(set(ids))


def test_roots(engine, tmp_path):
    e, root = engine
    tree(root, ["another.md"])
    assert listed(e) == ["."] and e.rescan(quick=True) == 1 and state(e) == truth(e)
    import shutil

    shutil.rmtree(root / "d2")
    assert e.rescan(quick=True) >= 1 and state(e) == truth(e)
    e.config = e.config.patched({"roots": [str(root), str(tmp_path / "none")]})
    e.rebuild()
    assert e.rescan(quick=True) == 0


def test_a_change_in_the_second_of_a_walk_is_not_missed(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, ["a/x", "b/y"])
    e = Engine(spark, str(tmp_path / "cat"), Config(roots=[str(root)])).start()
    stamp = os.stat(root / "a").st_mtime
    tree(root, ["a/z"])
    os.utime(root / "a", (stamp, stamp))  # the clock has not moved on
    assert time.time() - stamp < 60 and e.rescan(quick=True) >= 1 and state(e) == truth(e)


def test_of_several_rescans_one_is_whole(engine):
    e, root = engine
    (root / "top.md").write_text("written in place, twice as long")
    assert list(e.rescans(3, sleep=lambda _: None, whole_every=3)) == [0, 0, 1]


def test_only_topmost_new_directories_are_walked(spark, tmp_path, monkeypatch):
    tree(tmp_path, ["a/b/c/f.txt", "ab/g.txt"])
    created = spark.createDataFrame([(str(tmp_path / d), "upsert", 0, 1, True, i) for i, d in enumerate(("a", "a/b", "a/b/c", "ab"))], DELTA)
    got = [os.path.relpath(r["path"], tmp_path) for r in walk.below(created, walk.WalkOptions()).collect()]
    assert sorted(got) == ["a/b", "a/b/c", "a/b/c/f.txt", "ab/g.txt"]


def test_a_walk_enters_only_what_the_query_wants(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, [f"d{i}/e{j}/f{k}.txt" for i in range(3) for j in range(3) for k in range(3)] + ["d10/x.txt"])
    (root / "d1/e1/big.bin").write_bytes(b"x" * 5000)
    os.utime(root / "d1/e0/f0.txt", (5, 5))
    options, now = walk.WalkOptions([str(root)]), int(time.time())
    every = paths.derive(walk.walk(spark, options)).cache()
    for q in (
        Query(under=f"{root}/d1"),
        Query(under=f"{root}/d1/e1/", name="f size:>0"),
        Query(under="/nowhere"),
        Query(under="/"),
        Query(name="size:>=100"),
        Query(name="file: !f1"),
        Query(name="modified:1w ext:txt", under=f"{root}/d1"),
        Query(name="size:<100 ext:txt"),
        Query(under=str(root), include_dirs=False),
    ):
        got = sorted(r["path"] for r in walk.matching(spark, options, q, now).collect())
        assert got == sorted(r["path"] for r in search.matching(every, q, now).collect()), q
    assert len(walk.matching(spark, options, Query(under=f"{root}/d1"), now).collect()) == 14
    reader = walk.WalkReader(walk.WalkOptions([str(root)], under=f"{root}/d1/e1"))
    parts = reader.partitions()
    assert {os.path.relpath(p.directory, root) for p in parts} == {".", "d1", "d1/e1"}
    assert sorted(os.path.basename(r[0]) for p in parts for r in reader.read(p)) == ["big.bin", "e1", "f0.txt", "f1.txt", "f2.txt"]


def test_members_that_are_no_text(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in (("a.txt", "ü".encode()), ("b.png", b"\x89PNG\xff\xfe"), ("c.bin", b"x\0y"), ("d", b"")):
            z.writestr(name, body)
    rows = spark.createDataFrame([("/a.zip", "zip", data.getvalue()), ("/bad.zip", "zip", b"no"), ("/null.zip", "zip", None)], "path string, name_ext string, content binary")
    assert sorted((r["member"], r["text"]) for r in archives.member_texts(rows).collect()) == [("a.txt", "ü"), ("d", "")]
    assert archives.list_members(rows).count() == 4


def test_names_that_are_no_trash_entries(spark):
    items = spark.createDataFrame([(n, "/t/x") for n in ("x", "", ".", "..", "../y", "a/b", "..x")] + [(None, "/t/x")], "name string, original_path string")
    got = trash.restore_plan(items, spark.createDataFrame([], "path string")).collect()
    assert sorted(r["name"] for r in got) == ["..x", "x"] and len({r["free"] for r in got}) == 2
