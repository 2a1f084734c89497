"""The stored catalog: stable ids, early exit, commits of several writers, what is left on disk, counts in the record."""

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from pathlake.operators import search
from pathlake.plans.query import Category, Query
from pathlake.schema import DELTA, DETAILS, ENTRY
from pathlake.sources import catalog as stored
from pathlake.sources import documents
from pathlake.sources.catalog import Catalog
from pathlake.sources.shared import listing, put_if_absent, read_text

NOW = 2_000


def entries(spark, n, name="f"):
    return spark.createDataFrame([(f"/r/{name}{i:05}.{('txt', 'png', 'rs')[i % 3]}", i, 1 + i % 1000, False) for i in range(n)] + [("/r", 0, 1, True)], ENTRY)


def up(path, seq, size=7):
    return path, "upsert", size, 5, False, seq


def gone(path, seq):
    return path, "remove", None, None, None, seq


def delta(spark, rows):
    return spark.createDataFrame(rows, DELTA)


def ids(c):
    return {r["path"]: r["id"] for r in c.files().select("path", "id").collect()}


def test_ids_are_unique_and_stay(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 6))
    base = ids(c)
    assert sorted(base.values()) == list(range(1, 8)) and base["/r"] == 1
    # as of a rescan: one number for all changes
    c.apply(delta(spark, [up("/r/z", 3), up("/r/b", 3), up("/r/a/x", 3), gone("/r/f00001.png", 3), up("/r/f00002.rs", 3, 99)]))
    one = ids(c)
    new = [p for p in one if p not in base]
    assert len(set(one.values())) == len(one) and sorted(new, key=one.get) == ["/r/a/x", "/r/b", "/r/z"] and min(one[p] for p in new) > max(base.values())
    assert all(one[p] == base[p] for p in one if p in base) and "/r/f00001.png" not in one
    # later changes, also to the same paths, move none
    c.apply(delta(spark, [up("/r/a/w", 4), up("/r/b", 4, 1), gone("/r/a/x", 5), up("/r/a/x", 6)]))
    two = ids(c)
    assert all(two[p] == one[p] for p in one) and two["/r/a/w"] > max(one.values())
    assert c.compact(0) and ids(c) == two and not c.changes().count()
    c.apply(delta(spark, [up("/r/0", 7)]))
    assert ids(c)["/r/0"] > max(two.values())
    got = [r["path"] for r in search.search(c.files(), Query(limit=4), now=NOW, columns=("path",)).collect()]
    assert got == sorted(two, key=two.get)[:4] == [r["path"] for r in c.search(Query(limit=4), NOW, ("path",)).collect()]


def test_a_walk_gives_paths_their_order_again(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 3))
    c.apply(delta(spark, [up("/a", 1)]))
    c.rebuild(c.entries())
    assert ids(c) == {"/a": 1, "/r": 2, "/r/f00000.txt": 3, "/r/f00001.png": 4, "/r/f00002.rs": 5}


def test_a_removed_directory_that_comes_back_keeps_its_old_children_away(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 4))
    c.apply(delta(spark, [gone("/r", 1), ("/r", "upsert", 0, 1, True, 2), up("/r/new", 3)]))
    assert set(ids(c)) == {"/r", "/r/new"} and ids(c)["/r"] == 1


@pytest.fixture
def large(spark, tmp_path, monkeypatch):
    """2,000 entries in files of 100 rows, with changes all over; what is read of the snapshot is written down."""
    monkeypatch.setattr(stored, "SNAPSHOT_ROWS", 100)
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 2_000))
    rows = [gone(f"/r/f{i:05}.{('txt', 'png', 'rs')[i % 3]}", 1) for i in range(0, 2_000, 7)] + [up(f"/r/f{i:05}.{('txt', 'png', 'rs')[i % 3]}", 1, 10**9) for i in range(1, 2_000, 7)] + [up(f"/r/more{i:03}.txt", 2) for i in range(300)]
    c.apply(delta(spark, rows))
    read = []
    plain = c._stored
    monkeypatch.setattr(c, "_stored", lambda name, *files: (read.append(len(files)), plain(name, *files))[1])
    return c, read


@pytest.mark.parametrize(("name", "limit", "most"), [("f0", 20, 1), ("ext:png", 90, 7), ("more", 5, 99), ("nothing", 5, 99), ("", 1900, 99), ("size:>500MB", 40, 15), ("ext:txt", 5000, 99)])
def test_early_exit(large, name, limit, most):
    """The same rows as an ordered limit over everything; a frequent name reads few files."""
    c, read = large
    q = Query(name=name, limit=limit)
    want = [tuple(r) for r in search.search(c.files(), q, now=NOW, columns=("id", "path", "size")).collect()]
    c.search(q, NOW)  # what the changes leave is known from now on
    read.clear()
    got = [tuple(r) for r in c.search(q, NOW, ("id", "path", "size")).collect()]
    assert got == want and len({r[0] for r in got}) == len(got)
    assert len(read) == sum(n > 0 for n in read) and sum(read) <= most
    assert c._manifest(c.commit()["snapshot"]).count() > 15




def test_the_base_is_not_shuffled(large):
    c, _ = large
    plan = c.files()._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and not re.findall(r"(?<!Broadcast)Exchange", plan), plan


def test_counts_are_kept(large, monkeypatch):
    c, _ = large

    def recount():
        f = c.files()
        kinds = {k: search.count(f, Query(category=Category(k)), NOW).first()["n"] for k in ("Images", "Code", "Docs")}
        return f.filter("NOT is_dir").count(), f.filter("is_dir").count(), f.filter("NOT is_dir AND size >= 104857600").count(), kinds

    n = c.counts()
    assert (n["files"], n["dirs"], n["large"], {k: n[k.lower()] for k in ("Images", "Code", "Docs")}) == recount()
    first = c.facets(Query(), NOW).first().asDict()
    assert first == search.facets(c.files(), Query(), NOW).first().asDict()
    narrow = Query(name="more")
    assert c.facets(narrow, NOW).first().asDict() == search.facets(c.files(), narrow, NOW).first().asDict()

    def never(_):
        raise AssertionError("counted again")

    with monkeypatch.context() as m:
        m.setattr(c, "_counted", never)
        assert c.counts() == n and c.status()["files"] == n["files"]
    c.apply(delta(c.spark, [gone("/r/more005.txt", 3), up("/q", 3), up("/r/f00003.txt", 3)]))
    after = c.counts()
    assert after != n and (after["files"], after["dirs"], after["large"]) == recount()[:3]
    c.apply(delta(c.spark, [gone("/r", 4)]))
    assert c.counts()["files"] == 1 and c.counts()["dirs"] == 0


def test_put_if_absent(spark, tmp_path):
    at = str(tmp_path / "deep" / "one.json")
    assert put_if_absent(spark, at, "a ü") and not put_if_absent(spark, at, "b") and read_text(spark, at) == "a ü"
    won = []
    some = [threading.Thread(target=lambda i=i: won.append(put_if_absent(spark, str(tmp_path / "two"), str(i)))) for i in range(8)]
    [t.start() for t in some]
    [t.join() for t in some]
    assert sum(won) == 1 and [n for n, _ in listing(spark, str(tmp_path / "deep"))] == ["one.json"]


def test_writers_that_meet(spark, tmp_path):
    """Two rebuilds at once are two versions, and no change is lost that came while a snapshot was written."""
    at = str(tmp_path / "c")
    a, b = Catalog(spark, at), Catalog(spark, at)
    a.rebuild(entries(spark, 3))
    some = [threading.Thread(target=lambda c=c, n=n: c.rebuild(entries(spark, n))) for c, n in ((a, 4), (b, 5))]
    [t.start() for t in some]
    [t.join() for t in some]
    assert a.commit()["version"] == b.commit()["version"] == 3 and a.files().count() in (5, 6)
    a.apply(delta(spark, [up("/old", 1)]))
    write, late = a._write_snapshot, []

    def meanwhile(rows):
        name = write(rows)
        if not late:
            late.append(b.apply(delta(spark, [up("/late", 2), gone("/old", 2)])))
        return name

    a._write_snapshot = meanwhile
    assert a.compact(0) and late
    for c in (a, b, Catalog(spark, at)):
        assert "/late" in ids(c) and "/old" not in ids(c) and len(set(ids(c).values())) == len(ids(c)) and c.dirty() == 2
    # a compaction that a rebuild overtakes is dropped
    late.clear()
    a._write_snapshot = lambda rows: (write(rows), late or late.append(b.rebuild(entries(spark, 1))))[0]
    assert not a.compact(0) and set(ids(a)) >= {"/r", "/r/f00000.txt"} and a.commit()["snapshot"] == late[0]["snapshot"]


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "MOST_BATCHES", 3)
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 5))
    want = dict(ids(c))
    for i in range(9):
        c.apply(delta(spark, [up(f"/n{i}", i), gone(f"/n{i - 2}", i)]))
        c.add_texts(spark.createDataFrame([("/r/f00000.txt", f"t{i}"), (f"/n{i}", "x")], "path string, text string"), i)
    assert len(c.commit()["changes"]) <= 4 and len(c.commit()["texts"]) <= 4
    assert {p for p in ids(c) if p.startswith("/n")} == {"/n7", "/n8"} and {p: i for p, i in ids(c).items() if p in want} == want
    before = ids(c)
    assert {r["path"]: r["text"] for r in c.texts().collect()} == {"/r/f00000.txt": "t8", "/n7": "x", "/n8": "x"}
    assert c.compact(0) and ids(c) == before
    c.vacuum(keep=1, age=-5)
    left = {f: [n for n, _ in listing(spark, f"{c.dir}/{f}")] for f in ("snapshots", "manifests", "changes", "texts", "commits")}
    assert [len(left[f]) for f in ("snapshots", "manifests", "changes", "commits")] == [1, 1, 0, 1] and len(left["texts"]) <= 4
    assert ids(Catalog(spark, c.dir)) == before and c.text_stats().first()["entries"] == 3


def test_details_stay_with_the_snapshot(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    rows = [("/a.txt", 1, 1, False, 50, "ann", "g", 0o640, 7, 1), ("/b.txt", 1, 1, False, 90, "bob", "g", 0o600, 8, 2)]
    c.rebuild(spark.createDataFrame(rows, DETAILS))
    c.apply(delta(spark, [up("/c.txt", 1), up("/a.txt", 1, 9)]))
    got = {r["path"]: (r["size"], r["owner"], r["created"]) for r in c.detailed().collect()}
    assert got == {"/a.txt": (9, "ann", 50), "/b.txt": (1, "bob", 90), "/c.txt": (7, None, None)}
    assert [r["path"] for r in search.ranked(c.detailed(), Query(limit=2), "created", now=NOW).collect()] == ["/b.txt", "/a.txt"]
    assert c.compact(0) and {r["path"]: r["owner"] for r in c.detailed().collect()} == {"/a.txt": "ann", "/b.txt": "bob", "/c.txt": None}
    c.vacuum(keep=1, age=-5)
    assert c.detailed().filter("owner = 'bob'").count() == 1
    c.rebuild(entries(spark, 2))
    assert c.detailed().filter("owner IS NOT NULL").count() == 0 and "inode" in c.detailed().columns


def test_texts_that_are_still_to_come(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 2))
    assert c.pending_texts().count() == 0
    c.apply(delta(spark, [up("/x", 3), up("/y", 4), ("/d", "upsert", 0, 1, True, 5), gone("/r/f00000.txt", 6)]))
    assert sorted(tuple(r) for r in c.pending_texts().collect()) == [("/x", 3), ("/y", 4)]
    c.add_texts(spark.createDataFrame([("/x", "t", 3), ("/y", "old", 2)], "path string, text string, seq long"))
    assert [tuple(r) for r in c.pending_texts().collect()] == [("/y", 4)]


def test_an_empty_batch_is_no_commit(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    c.rebuild(entries(spark, 0).limit(0))
    assert c.apply(delta(spark, [])) is None and c.files().count() == 0 and c.search(Query(), NOW).count() == 0 and c.counts()["files"] == 0
    c.apply(delta(spark, [up("/x", 0)]))
    assert [r["path"] for r in c.search(Query(), NOW).collect()] == ["/x"] and c.next_seq() == 1


def test_eviction_by_order_and_path(spark):
    """Ties, one number for all, a number with most rows, nulls, clashing columns: just what doesn't fit goes."""
    rnd = random.Random(3)
    schema = "path string, text string, seq long"

    def kept(rows, cap):
        groups, left, out = {}, cap, []
        for p, t, s in rows:
            groups.setdefault((s is None, -(s or 0), p is None, p or ""), []).append((p, t, s))
        for k in sorted(groups):
            left -= sum(len((t or "").encode()) for _, t, _ in groups[k])
            if left < 0:
                break
            out += groups[k]
        return sorted(out, key=str)

    tables = [
        [(f"/{i}", "x" * 100, 7) for i in range(10)],
        [(f"/{i:04}", "ü" * rnd.randrange(20), 5 if i % 10 else i) for i in range(700)],
        [(rnd.choice(["/a", "/b", None]), rnd.choice(["", "xx", None]), rnd.choice([1, 2, None])) for _ in range(60)],
        [("/big", "x" * 5000, 9), ("/small", "x", 1)],
    ]
    for rows in tables:
        df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS __n", "2 AS __b", "3 AS at", "4 AS `a.b`").repartition(5)
        for cap in (0, 1, 500, 501, 2_000, 10**9):
            got = documents.within_cap(df, cap)
            assert got.columns == df.columns and sorted((tuple(r)[:3] for r in got.collect()), key=str) == kept(rows, cap), cap
    assert documents.within_cap(spark.createDataFrame([], schema), 5).count() == 0
