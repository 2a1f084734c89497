"""Overlay, exclusions, duplicates, tags, trash, codecs."""

import hashlib
import json

from pyspark.sql import functions as F

from pathlake.functions import codecs, paths
from pathlake.operators import duplicates, exclusions, overlay, search, tags, trash
from pathlake.plans.query import Query
from pathlake.schema import DELTA, ENTRY

SAMPLE = [("/home/u/docs/report.pdf", 5000, 1, False), ("/home/u/docs/notes.md", 40, 1, False), ("/home/u/docs/sub", 0, 1, True)]


def merged(spark, base, delta, base_seq=-1):
    rows = overlay.merge(spark.createDataFrame(base, ENTRY), spark.createDataFrame(delta, DELTA), base_seq)
    return {r["path"]: r["size"] for r in rows.collect()}


def up(path, seq, size=1):
    return path, "upsert", size, 1, False, seq


def gone(path, seq):
    return path, "remove", None, None, None, seq


def test_overlay(spark):
    delta = [up("/home/u/docs/new.pdf", 1, 7), up("/home/u/docs/report.pdf", 2, 9999), gone("/home/u/docs/notes.md", 3)]
    got = merged(spark, SAMPLE, delta)
    assert got == {"/home/u/docs/new.pdf": 7, "/home/u/docs/report.pdf": 9999, "/home/u/docs/sub": 0}
    assert overlay.dirty(spark.createDataFrame(delta, DELTA)).first()["n"] == 3
    assert merged(spark, [], [gone("/x", 1), up("/x", 2)]) == {"/x": 1} and merged(spark, [], [up("/x", 1), gone("/x", 2)]) == {}
    base = [(p, 1, 1, False) for p in ("/a", "/a/x/y.txt", "/ab/c", "/a.txt")]
    assert set(merged(spark, base, [gone("/a", 5)])) == {"/ab/c", "/a.txt"}
    assert set(merged(spark, base, [gone("/a", 5), up("/a/x", 6)])) == {"/ab/c", "/a.txt", "/a/x"}
    assert set(merged(spark, base, [gone("/a", 5), up("/a", 6)])) == {"/ab/c", "/a.txt", "/a"}
    assert set(merged(spark, base, [gone("/a", 5)], base_seq=5)) == {p for p, *_ in base}


def test_prune(spark):
    base = spark.createDataFrame([("/gone.txt", 1, 1, False), ("/d/x", 1, 1, False)], ENTRY)
    delta = spark.createDataFrame([up("/new.txt", 1), up("/gone.txt", 1), gone("/gone.txt", 2), gone("/nowhere", 3), up("/d/x", 4), gone("/d", 5)], DELTA)
    assert {(r["path"], r["op"]) for r in overlay.prune(delta, base).collect()} == {("/new.txt", "upsert"), ("/gone.txt", "remove"), ("/d", "remove")}


def test_ids_follow_paths(spark):
    rows = spark.createDataFrame([(f"/p{i:03}", 1, 1, False) for i in range(200)], ENTRY).repartition(5)
    got = overlay.assign_ids(rows).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 201)) and [r["path"] for r in got] == sorted(r["path"] for r in got)
    assert overlay.assign_ids(rows.limit(0)).count() == 0


def test_exclusions(spark):
    listing = [("/u/go/pkg/mod/a", 1, 1, False), ("/u/pkg/mod/b", 1, 1, False), ("/u/node_modules", 0, 1, True), ("/u/node_modules/x.js", 1, 1, False), ("/u/target", 1, 1, False), ("/u/.cache/y", 1, 1, False), ("/u/.hid", 1, 1, False), ("/u/go/pkg/mod", 0, 1, True)]
    files = paths.derive(spark.createDataFrame(listing, ENTRY))
    names = exclusions.ExcludeNames.parse("node_modules,target/\n# c\r\ngo/pkg/mod,,")
    assert (names.names, names.suffixes) == (["node_modules", "target"], ["go/pkg/mod"])
    keep = lambda **k: {r["path"] for r in exclusions.pruned(files, names, **k).collect()}
    assert keep() == {"/u/pkg/mod/b", "/u/target", "/u/.cache/y", "/u/.hid"}
    assert keep(index_hidden_dirs=False) == {"/u/pkg/mod/b", "/u/target", "/u/.hid"}
    assert "/u/node_modules/x.js" in keep(roots=("/u/node_modules",))
    assert len(exclusions.ExcludeNames.default().names) + len(exclusions.ExcludeNames.default().suffixes) >= 40
    assert {r["path"] for r in exclusions.in_roots(files, ["/u/go"]).collect()} == {"/u/go/pkg/mod/a", "/u/go/pkg/mod"}
    assert exclusions.in_roots(files, []).count() == 0
    out = exclusions.excluded_by(files, spark.createDataFrame([("/u/go",), ("/u/no",)], "path string"))
    assert {r["path"] for r in out.collect()} == {r["path"] for r in exclusions.not_excluded(files, ["/u/go/", "/u/no"]).collect()} and out.count() == 6
    mounts = spark.createDataFrame([("proc", "/proc", "proc"), ("/dev/sdb1", "/media/u/stick", "vfat"), ("srv:/x", "/mnt/n", "nfs4"), ("/dev/sda", "/", "ext4"), ("o", "/home", "overlay"), ("t", "/tmp", "tmpfs")], "device string, point string, fstype string")
    assert {r["point"] for r in exclusions.mounts_excluded(mounts, ["/home/u"]).collect()} == {"/proc", "/media/u/stick", "/mnt/n"}
    assert exclusions.effective_roots(["/b/", "/a", "/b"], "/h") == ["/a", "/b"] and exclusions.effective_roots([], "/h/") == ["/h"]


def test_duplicates(spark):
    rows = [("/a", "xx", 1), ("/b", "xx", 9), ("/c", "xy", 1), ("/d", "", 1), ("/e", "", 1), ("/f", "q" * 70000, 1), ("/g", "q" * 70000, 1), ("/h", "q" * 69999 + "r", 1)]
    df = spark.createDataFrame([(p, len(c), m, False, c.encode(), i if p not in ("/f", "/g") else 99) for i, (p, c, m) in enumerate(rows)], "path string, size long, mtime long, is_dir boolean, content binary, inode long")
    got = duplicates.duplicate_groups(duplicates.duplicate_members(df)).collect()
    assert [(r["n"], r["waste"], r["keep"]) for r in got] == [(2, 70000, "/g"), (2, 2, "/b")]
    assert [r["keep"] for r in duplicates.duplicate_groups(duplicates.duplicate_members(df, inode="inode")).collect()] == ["/b"]
    assert {r["path"] for r in duplicates.find_by_hash(df, hashlib.sha256(b"xx").hexdigest().upper() + " ").collect()} == {"/a", "/b"}


def test_tags(spark, tmp_path):
    doc = tmp_path / "tags.json"
    doc.write_text(json.dumps({"version": 1, "tags": {"/a": ["work", " #urgent", "bad\u0007"], "/b": ["##work", "#", ""]}}))
    t = tags.load(spark, str(doc))
    assert {(r["tag"], r["n"]) for r in tags.histogram(t).collect()} == {("work", 2), ("urgent", 1)}
    files = paths.derive(spark.createDataFrame([("/a", 1, 1, False), ("/c", 1, 1, False)], ENTRY))
    assert [r["path"] for r in tags.tagged(files, t, "#work").collect()] == ["/a"]
    assert {r["path"]: list(r["tags"]) for r in tags.with_tags(files, t).collect()} == {"/a": ["urgent", "work"], "/c": []}
    assert {(r["path"], r["tag"]) for r in tags.prune_missing(t, files).collect()} == {("/a", "work"), ("/a", "urgent")}
    left = tags.remove(t, spark.createDataFrame([("/b",)], "path string"), " work")
    assert json.loads(tags.to_json(left)) == {"version": 1, "tags": {"/a": ["urgent", "work"]}}
    assert tags.add(left, spark.createDataFrame([("/b",)], "path string"), "#new").count() == 3
    assert tags.load(spark, str(tmp_path / "none.json")).count() == 0


def test_trash(spark):
    rec = [("/t/a.txt.trashinfo", "[Trash Info]\nPath=/a%20b/c\nDeletionDate=2024-01-02T00:00:00\n"), ("/t/b.trashinfo", "[Trash Info]\nPath=/caf%C3%A9\nDeletionDate=2024-05-02T00:00:00\n"), ("/t/lost.trashinfo", "[Trash Info]\nPath=/a%zz\nDeletionDate=2025\n"), ("/t/bad.trashinfo", "x")]
    info = trash.parse_info(spark.createDataFrame(rec, "file string, value string"))
    got = trash.listing(info, spark.createDataFrame([("a.txt",), ("b",)], "name string")).collect()
    assert [(r["name"], r["original_path"]) for r in got] == [("b", "/café"), ("a.txt", "/a b/c")]
    for p in ("/a b/c", "/café", "/x~y*z+&%", "/ünï/ok-1_2.t"):
        assert codecs.decode_path(codecs.encode_path(p)) == p
        assert spark.range(1).select(codecs.encode_path_column(F.lit(p))).first()[0] == codecs.encode_path(p)
    for p in ("/a%zz", "/a+b%2", "%", "%41%4g%C3%A9", "/plain é", "/%2541"):
        assert spark.range(1).select(codecs.decode_path_column(F.lit(p))).first()[0] == codecs.decode_path(p), p
    assert codecs.decode_path("/a%zz") == "/a%zz"
    plan = trash.trash_plan(spark.createDataFrame([("/x/n.txt",), ("/y/n.txt",)], "path string"), spark.createDataFrame([("n.txt",)], "name string"), "2024-01-01T00:00:00").collect()
    assert {(r["path"], r["name"]) for r in plan} == {("/x/n.txt", "n.txt.2"), ("/y/n.txt", "n.txt.3")} and "Path=/x/n.txt" in "".join(r["info"] for r in plan)
    back = trash.restore_plan(info, spark.createDataFrame([("/café",)], "path string")).collect()
    assert {r["target"]: r["conflict"] for r in back}["/café"] is True


def test_planned_names_never_meet(spark):
    """Names that look like numbered ones, whether in use or wanted, are never given to another."""
    wanted = [f"/{d}/{n}" for d in "uvw" for n in ("a.txt", "a.txt.2", "a.txt.7", "b", "c.3", "9", ".2", "x.02")]
    taken = ["a.txt", "a.txt.2", "c.3", "c.4", "b.2"]
    rows = trash.trash_plan(spark.createDataFrame([(p,) for p in wanted], "path string"), spark.createDataFrame([(n,) for n in taken], "name string"), "2024").collect()
    names = [r["name"] for r in rows]
    assert len(names) == len(wanted) == len(set(names)) and not set(names) & set(taken)
    assert {"a.txt.7", "b", "9", ".2", "x.02"} <= set(names) and {r["path"]: r["name"] for r in rows}["/u/c.3"] == "c.5"
    items = spark.createDataFrame([("1", "/d/r.txt"), ("2", "/d/r.txt"), ("3", "/e/r.txt"), ("4", "/q"), ("5", "/d/k.tar.gz")], "name string, original_path string")
    existing = spark.createDataFrame([("/d/r.txt",), ("/d/r.2.txt",), ("/d/k.tar.gz",), ("/other/r.txt",)], "path string")
    got = {r["name"]: (r["conflict"], r["free"]) for r in trash.restore_plan(items, existing).collect()}
    assert got == {"1": (True, "/d/r.3.txt"), "2": (True, "/d/r.4.txt"), "3": (False, "/e/r.txt"), "4": (False, "/q"), "5": (True, "/d/k.tar.2.gz")}


def test_ids_beyond_the_range_sampler(spark):
    """More rows than the sampler of ranges takes: its bounds differ from run to run."""
    rows = spark.range(1_000_000).select(F.concat(F.lit("/p"), F.xxhash64("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), F.lit(False).alias("is_dir"))
    got = overlay.assign_ids(rows.repartition(16))
    n = got.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    assert tuple(n) == (1_000_000, 1_000_000, 1, 1_000_000)
    w = got.select("path", "id").orderBy("path").select("id").rdd.map(lambda r: r[0]).take(2000)
    assert w == list(range(1, 2001))


def test_many_tombstones_and_prefixes(spark):
    """Beyond the few that are written into the plan, the joins say the same."""
    base = spark.createDataFrame([(f"/d{i % 50}/f{i}", 1, 1, False) for i in range(400)], ENTRY)
    delta = [gone(f"/d{i}", 5) for i in range(0, 50, 3)] + [gone(f"/none{i}", 5) for i in range(overlay.INLINE + 10)] + [up("/d3/new", 6), up("/d6/old", 4)]
    got = {r["path"] for r in overlay.merge(base, spark.createDataFrame(delta, DELTA)).collect()}
    assert got == {f"/d{i % 50}/f{i}" for i in range(400) if i % 50 % 3} | {"/d3/new"}
    files = paths.derive(base)
    many = [f"/d{i}" for i in range(0, 50, 3)] + [f"/none{i}" for i in range(overlay.INLINE)]
    left = exclusions.excluded_by(files, spark.createDataFrame([(p,) for p in many], "path string"))
    assert {r["path"] for r in left.collect()} == {f"/d{i % 50}/f{i}" for i in range(400) if i % 50 % 3}


def test_rename_preview(spark):
    rows = paths.derive(spark.createDataFrame([("/d/a1.txt", 1, 1, False), ("/d/a2.txt", 1, 1, False), ("/d/b1.txt", 1, 1, False), ("/d/c.txt", 1, 1, False)], ENTRY))
    got = {r["path"]: (r["new_path"], r["conflict"]) for r in trash.rename_preview(rows, rows, "a", "b").collect()}
    assert got == {"/d/a1.txt": ("/d/b1.txt", True), "/d/a2.txt": ("/d/b2.txt", False)}
    got = [r["new_path"] for r in trash.rename_preview(rows.filter("name LIKE 'a%'"), rows, r"^a\d", "n{n}", regex=True, counter=True).orderBy("path").collect()]
    assert got == ["/d/n1.txt", "/d/n2.txt"]


def test_codecs(spark):
    assert codecs.octal_unescape(r"/mnt/a\040b\134\9") == "/mnt/a b\\\\9"
    for p in ("/a b", "/it's", "/plain.txt"):
        assert spark.range(1).select(codecs.shell_quote(F.lit(p))).first()[0] == codecs.shell_quote_text(p)
    assert spark.range(1).select(codecs.file_uri(F.lit("/a b/é"))).first()[0] == "file:///a%20b/%C3%A9"


def test_lookups(spark):
    files = paths.derive(spark.createDataFrame([("/a", 5, 6, False), ("/d", 0, 1, True), ("/e", 0, 1, True), ("/d/z", 0, 1, False)], ENTRY))
    got = {r["path"]: (r["size"], r["is_dir"]) for r in search.lookup(files, spark.createDataFrame([("/a",), ("/no",)], "path string")).collect()}
    assert got == {"/a": (5, False), "/no": (0, False)}
    assert {r["path"] for r in search.empty_entries(files).collect()} == {"/e", "/d/z"}
    links = spark.createDataFrame([("/l1", "/a"), ("/l2", "/no")], "path string, target string")
    assert [r["path"] for r in search.broken_links(links, files).collect()] == ["/l2"]
    assert {r["root"]: (r["files"], r["dirs"]) for r in search.root_counts(files, ["/d", "/x"]).collect()} == {"/d": (1, 1), "/x": (0, 0)}
    assert search.row_columns(search.matching(files, Query(), 10)).filter("path = '/d'").first()["type"] == "Folder"
