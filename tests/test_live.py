"""What follows a tree as it changes: rescans, restarts of the watching source, live content, settings, the watch command."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from pathlake.cli import main
from pathlake.config import Config, expand
from pathlake.engine import Engine, handle
from pathlake.functions import codecs
from pathlake.operators import exclusions, search, tags
from pathlake.plans.query import Query, QueryError
from pathlake.schema import DELTA, ENTRY
from pathlake.sources import documents, walk
from pathlake.sources.catalog import Catalog
from pathlake.streaming import cdc


def tree(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def names(rows):
    return sorted(os.path.basename(r["path"]) for r in rows.collect())


@pytest.fixture
def engine(spark, tmp_path):
    tree(tmp_path / "tree", {"a/one.txt": "alpha\n", "a/two.md": "beta", "b/c/three.txt": "gamma"})
    return Engine(spark, str(tmp_path / "cat"), Config(roots=[str(tmp_path / "tree")])).start(), tmp_path / "tree"


def test_rescan(engine):
    e, root = engine
    assert e.rescan() == 0
    tree(root, {"a/one.txt": "alpha and more\n", "d/new.txt": "x"})
    os.utime(root / "a/one.txt", (5, 5))
    (root / "a/two.md").unlink()
    assert e.rescan() >= 4  # one changed, one gone, a directory and its file; and directories whose times are new
    assert names(e.search(Query(include_dirs=False)).results) == ["new.txt", "one.txt", "three.txt"] and e.rescan() == 0
    waited = []
    (root / "d/new.txt").unlink()
    assert [n > 0 for n in e.rescans(2, sleep=waited.append)] == [True, False] and waited == [30, 30] and e.status()["degraded"]
    e.config = e.config.patched({"paused": True, "rescan_interval_secs": 1})
    (root / "a/one.txt").unlink()
    assert list(e.rescans(1, sleep=waited.append)) == [0] and waited[-1] == Engine.RESCAN_LEAST


def test_content_is_read_as_it_is_now(engine):
    e, root = engine
    assert names(e.search(Query(content="alpha")).results) == ["one.txt"]
    (root / "a/one.txt").write_text("changed marker")
    assert names(e.search(Query(content="marker")).results) == ["one.txt"] and not names(e.search(Query(content="alpha")).results)
    # a cached text stands for its file
    e.catalog.add_texts(e.spark.createDataFrame([(str(root / "a/two.md"), "cached words")], "path string, text string"), 1)
    assert names(e.search(Query(content="cached")).results) == ["two.md"] and not names(e.search(Query(content="beta")).results)
    assert [s["pushed"] for s in [{"pushed": e.catalog.text_stats().first()["entries"]}]] == [1]
    e.config = e.config.patched({"content_index": True})
    e.index_texts(str(root), 2)
    assert e.catalog.text_stats().first()["entries"] == 3
    e.catalog.remove_texts_under(e.spark.createDataFrame([(str(root / "a"),)], "path string"), 3)
    assert names(e.catalog.texts()) == ["three.txt"]
    assert not e.patch({"content_index": False}) and e.catalog.text_stats().first()["entries"] == 0
    with pytest.raises(QueryError):
        e.search(Query(content="ab"), interactive=True)
    assert names(e.search(Query(content="gamma"), interactive=True).results) == ["three.txt"]


def test_cached_or_live(spark, tmp_path):
    tree(tmp_path, {"x.txt": "live x", "y.txt": "live y", "z.bin": "a\0b"})
    wanted = spark.createDataFrame([(str(tmp_path / n),) for n in ("x.txt", "y.txt", "z.bin", "none")], "path string")
    cached = spark.createDataFrame([(str(tmp_path / "y.txt"), "kept y"), ("/other", "o")], "path string, text string")
    assert {os.path.basename(r["path"]): r["text"] for r in documents.cached_or_live(wanted, cached).collect()} == {"x.txt": "live x", "y.txt": "kept y"}


def test_mounts_are_left_out_of_the_walk(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, {"stay/a.txt": "", "net/b.txt": "", "proc/c.txt": "", "disk/d.txt": ""})
    table = tmp_path / "mounts"
    table.write_text(f"srv:/x {root}/net nfs4 rw 0 0\nproc {root}/proc proc rw 0 0\n/dev/sda {root}/disk ext4 rw 0 0\noverlay {root} overlay rw 0 0\n")
    e = Engine(spark, str(tmp_path / "cat"), Config(roots=[str(root)]), str(table)).start()
    assert names(e.search(Query(include_dirs=False)).results) == ["a.txt", "d.txt"]
    assert e.patch({"exclude_network": False}) and names(e.search(Query(include_dirs=False)).results) == ["a.txt", "b.txt", "d.txt"]
    assert e.patch({"extra_excluded_fstypes": ["ext4"]}) and names(e.search(Query(include_dirs=False)).results) == ["a.txt", "b.txt"]
    stick = spark.createDataFrame([("/dev/sdb1", "/media/u/s", "vfat")], "device string, point string, fstype string")
    assert exclusions.mounts_excluded(stick, ["/h"]).count() == 1 and exclusions.mounts_excluded(stick, ["/h"], exclude_removable=False).count() == 0


def test_a_catalog_that_is_not_to_persist(spark, tmp_path):
    tree(tmp_path / "t", {"a": ""})
    e = Engine(spark, str(tmp_path / "cat"), Config(roots=[str(tmp_path / "t")], persist_index=False)).start()
    assert e.count(Query()) == 1 and not (tmp_path / "cat").exists()
    e.close()
    assert e.catalog.commit() is None


def test_watch_command(spark, engine, tmp_path, monkeypatch):
    e, root = engine
    told = []

    def sleep(_):
        tree(root, {f"a/late{len(told)}.txt": "x"})
        told.append(e.rescan())

    got = [[os.path.basename(r["path"]) for r in rows] for rows in e.watch(Query(name="*.txt", limit=9), 1, 3, sleep)]
    assert [sorted(x) for x in got] == [["one.txt", "three.txt"], ["late0.txt"], ["late1.txt"]]
    out = io.StringIO()
    assert main(["watch", "*.md", "--catalog", str(tmp_path / "cat"), "--json", "--times", "1"], spark, out) == 0
    row = json.loads(out.getvalue())
    assert row["path"].endswith("two.md") and row["size"] == 4 and row["is_dir"] is False
    conf = tmp_path / "conf.json"
    e.config.save(str(conf))
    out = io.StringIO()
    (root / "a/two.md").unlink()
    assert main(["rescan", "--catalog", str(tmp_path / "cat"), "--config", str(conf)], spark, out) == 0 and int(out.getvalue()) >= 1
    assert json.loads(handle(e, '{"op": "rescan"}')) == {"changed": 0} and json.loads(handle(e, '{"op": "text_stats"}'))["entries"] == 0


def test_watching_goes_on_after_a_restart(spark, tmp_path):
    """What changed while no query ran is reported with its true kind, under numbers that go on."""
    root, state, out, offsets = tmp_path / "tree", str(tmp_path / "state.json"), str(tmp_path / "out"), str(tmp_path / "offsets")
    tree(root, {"a.txt": "1", "b.txt": "2", "c.txt": "3"})

    def run():
        q = walk.events(spark, walk.WalkOptions([str(root)]), state).writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(processingTime="500 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        return {(os.path.basename(r["path"]), r["kind"]): r["seq"] for r in spark.read.parquet(out).collect()}

    first = run()
    assert set(first) == {(n, "create") for n in ("a.txt", "b.txt", "c.txt")}
    (root / "a.txt").unlink()
    (root / "b.txt").write_text("22 and more")
    (root / "d.txt").write_text("4")
    again = run()
    assert set(again) - set(first) == {("a.txt", "remove"), ("b.txt", "data"), ("d.txt", "create")}
    assert min(again[k] for k in set(again) - set(first)) > max(first.values())


def test_a_created_directory_is_walked(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, {"new/x.txt": "1", "new/deep/y.txt": "22", "new/node_modules/z.js": ""})
    src, c = tmp_path / "events", Catalog(spark, str(tmp_path / "cat"))
    c.rebuild(spark.createDataFrame([], ENTRY))
    rows = [(str(root / "new"), "create", 0, 1, True, 4), (str(root / "gone"), "create", 0, 1, True, 5)]
    spark.createDataFrame(rows, "path string, kind string, size long, mtime long, is_dir boolean, seq long").write.json(str(src))
    shown = []
    stream = spark.readStream.schema("path string, kind string, size long, mtime long, is_dir boolean, seq long").json(str(src))
    cdc.ingest(stream, c, str(tmp_path / "cp"), walk_created=walk.WalkOptions(), after=shown.append).awaitTermination()
    assert names(c.entries()) == ["deep", "gone", "new", "x.txt", "y.txt"] and shown == [0]
    seen = []
    cdc.live_results(stream, c, Query(name="new"), lambda df: seen.append(df.count()), str(tmp_path / "cp2"), availableNow=True).awaitTermination()
    assert seen == [1]


def test_texts_follow_the_changes(spark, tmp_path):
    """A text has its change's number: a later stream with smaller batch numbers loses against it, and a removal takes the text away."""
    c = Catalog(spark, str(tmp_path / "cat"))
    c.rebuild(spark.createDataFrame([(f"/{n}", 1, 1, False) for n in "abc"], ENTRY))
    src = tmp_path / "changes"
    said = {"t": "old"}
    read = lambda wanted: wanted.select("path", F.lit(said["t"]).alias("text"))

    def stream(rows, name):
        spark.createDataFrame(rows, DELTA).coalesce(1).write.mode("append").json(str(src))
        cdc.extract_stream(spark.readStream.schema(DELTA).json(str(src)), c, read, str(tmp_path / name)).awaitTermination()

    stream([("/a", "upsert", 1, 1, False, 10), ("/b", "upsert", 1, 1, False, 11), ("/c", "upsert", 1, 1, False, 12)], "one")
    said["t"] = "new"
    stream([("/a", "upsert", 2, 2, False, 20), ("/b", "remove", None, None, None, 21)], "one")
    assert {r["path"]: r["text"] for r in c.texts().collect()} == {"/a": "new", "/c": "old"}


def test_ignore_files_of_git(spark, tmp_path, monkeypatch):
    home, root = tmp_path / "home", tmp_path / "tree"
    tree(home, {".config/git/ignore": "*.bak\n"})
    tree(root, {".git/info/exclude": "secret*\n", ".gitignore": "!keep.bak\n", "a.bak": "", "keep.bak": "", "secret.txt": "", "sub/secret2": "", "b.txt": ""})
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)

    def listed(**o):
        w = walk.Walker(walk.WalkOptions([str(root)], **o))
        return {os.path.relpath(e[0], root) for e in w.walk(str(root), w.rules_above(str(root)))}

    assert listed() == {".gitignore", "keep.bak", "sub", "b.txt"}
    assert {"a.bak", "secret.txt"} <= listed(respect_ignore=False)
    tree(home, {".gitconfig": "[user]\n name = x\n[core]\n excludesFile = ~/mine\n", "mine": "b.*\n"})
    assert listed() == {".gitignore", "keep.bak", "a.bak", "sub"}


def test_a_walk_splits_large_subtrees(spark, tmp_path):
    tree(tmp_path, {f"only/d{i:02}/e{j}/f.txt": "" for i in range(12) for j in range(12)})
    reader = walk.WalkReader(walk.WalkOptions([str(tmp_path)]))
    parts = reader.partitions()
    assert len(parts) > walk.PARTS
    rows = [r for p in parts for r in reader.read(p)]
    assert len(rows) == len({r[0] for r in rows}) == 1 + 12 + 144 + 144
    assert {r["path"] for r in walk.walk(spark, walk.WalkOptions([str(tmp_path)])).collect()} == {r[0] for r in rows}


def test_details(spark, tmp_path):
    tree(tmp_path, {"a.txt": "x"})
    os.chmod(tmp_path / "a.txt", 0o640)
    os.link(tmp_path / "a.txt", tmp_path / "b.txt")
    rows = walk.walk(spark, walk.WalkOptions([str(tmp_path)], details=True))
    got = {os.path.basename(r["path"]): r for r in rows.collect()}
    st = os.stat(tmp_path / "a.txt")
    assert got["a.txt"]["permissions"] == 0o640 and got["a.txt"]["inode"] == got["b.txt"]["inode"] == st.st_ino and got["a.txt"]["links"] == 2 and got["a.txt"]["owner"]
    from pathlake.functions import paths

    made = paths.derive(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("created", F.when(F.col("path").endswith("b.txt"), 9).otherwise(1)))
    assert names(search.ranked(made, Query(limit=1), "created", now=1)) == ["b.txt"]


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PATHLAKE_CONTENT_INDEX", " On ")
    monkeypatch.setenv("PATHLAKE_PAUSED", "perhaps")
    assert Config.load(str(tmp_path / "none")).content_index and not Config.load(str(tmp_path / "none")).paused
    (tmp_path / "real").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "link")
    assert expand(str(tmp_path / "link"), "/h") == str(tmp_path / "real") and expand("~/nowhere", "/h") == "/h/nowhere"
    assert Config(roots=[str(tmp_path / "link"), str(tmp_path / "real")]).walk_options().roots == [str(tmp_path / "real")]


def test_tag_documents(spark, tmp_path):
    at = str(tmp_path / "tags.json")
    relation = spark.createDataFrame([("/a", "work"), ("/b", "x y")], "path string, tag string")
    assert tags.save(relation, at) and not tags.save(relation, at) and json.load(open(at))["version"] == 1
    assert sorted(map(tuple, tags.load(spark, at).collect())) == [("/a", "work"), ("/b", "x y")]
    (tmp_path / "bad.json").write_text("no json")
    assert tags.load(spark, str(tmp_path / "bad.json")).count() == 0


def test_path_hashes_and_times(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 & (1 << 64) - 1
        return f"{h:016x}"

    texts = ["", "/", "/home/ü/naïve €.txt", "/" + "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "p string").select(codecs.path_hash(F.col("p")), codecs.spool_name(F.col("p"))).collect()
    assert [r[0] for r in got] == [fnv(t.encode()) for t in texts] and got[1][1] == fnv(b"/") + ".txt"
    assert spark.range(1).select(codecs.local_time(F.lit(86_399))).first()[0] == "1970-01-01T23:59:59"
