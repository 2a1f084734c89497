"""Walks, ignore files, documents, archives, the stored catalog, streams, the engine and the command line."""

import io
import json
import os
import tarfile
import zipfile
import zlib

import pytest

from pathlake.cli import main
from pathlake.config import Config
from pathlake.engine import Engine, handle
from pathlake.operators import search
from pathlake.plans.query import Query
from pathlake.schema import DELTA, ENTRY, EVENT
from pathlake.sources import archives, documents, export, ignore, mounts, walk
from pathlake.sources.catalog import Catalog
from pathlake.streaming import cdc


def tree(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def listed(spark, root, **options):
    rows = walk.walk(spark, walk.WalkOptions([str(root)], **options)).collect()
    return {os.path.relpath(r["path"], root) for r in rows}


def test_walk(spark, tmp_path):
    tree(tmp_path, {"a/one.txt": "1", "a/sub/two.txt": "22", ".secret": "s", "node_modules/x.js": "", "b/.gitignore": "*.log\n!keep.log\n/top\n", "b/x.log": "", "b/keep.log": "", "b/top/in.txt": "", "b/c/top": "", ".hid/z": "", "_u/v": ""})
    got = listed(spark, tmp_path)
    assert got == {"a", "a/one.txt", "a/sub", "a/sub/two.txt", ".secret", "b", "b/.gitignore", "b/keep.log", "b/c", "b/c/top", "_u", "_u/v"}
    assert {".hid", ".hid/z"} <= listed(spark, tmp_path, index_hidden_dirs=True)
    assert "b/x.log" in listed(spark, tmp_path, respect_ignore=False) and "node_modules/x.js" in listed(spark, tmp_path, exclude_names="")
    assert "a/one.txt" not in listed(spark, tmp_path, excluded=[str(tmp_path / "a")])
    assert listed(spark, tmp_path, dirs_only=True) == {"a", "a/sub", "b", "b/c", "_u"}
    rows = walk.walk(spark, walk.WalkOptions([str(tmp_path), str(tmp_path / "a")]))
    assert rows.count() == rows.select("path").distinct().count() == 12
    assert {r["path"]: r["size"] for r in rows.collect()}[str(tmp_path / "a/sub/two.txt")] == 2
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    assert "a/loop" in listed(spark, tmp_path)
    assert len(listed(spark, tmp_path, follow_symlinks=True)) < 60
    assert walk.WalkOptions(["/a"]).fingerprint() != walk.WalkOptions(["/a"], respect_ignore=False).fingerprint()


@pytest.mark.parametrize(("rules", "path", "is_dir", "want"), [("*.log", "a/b.log", False, True), ("/x", "a/x", False, None), ("/x", "x", False, True), ("x/", "x", False, None), ("x/", "x", True, True), ("a/**/z", "a/z", False, True), ("a/**/z", "a/q/r/z", False, True), ("**/n", "q/n", False, True), ("d/**", "d/e/f", False, True), ("*.a\n!k.a", "k.a", False, False), (r"\#h", "#h", False, True), ("# c", "# c", False, None), ("a?[0-9]", "ab7", False, True), ("a*b", "a/b", False, None), ("[!a]x", "bx", False, True)])
def test_ignore_rules(rules, path, is_dir, want):
    assert ignore.verdict(ignore.parse(rules), path, is_dir) is want


def package(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return b.getvalue()


def test_documents(spark):
    w = lambda body: f'<w:d xmlns:w="w">{body}</w:d>'
    docx = package(
        word__document_xml=w("<w:p><w:r><w:t>R&amp;D one</w:t><w:tab/><w:t>two</w:t><w:br/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>c</w:t></w:p></w:tc></w:tr></w:tbl>"), word__header1_xml=w("<w:p><w:t>head</w:t></w:p>"), word__styles_xml=w("<w:p><w:t>style</w:t></w:p>")
    )
    text = documents.extract("docx", docx)
    assert text == "R&D one\ttwo\n\nc\n\t\nhead\n"
    odt = package(content_xml='<o xmlns:text="t"><text:p><text:span>a</text:span><text:s/>b 12&#37;.</text:p></o>', meta_xml="<m>no</m>")
    assert documents.extract("odt", odt) == "a b 12%.\n"
    assert documents.package_text(package(word__document_xml=w("<w:p><w:t>" + "x" * 4096 + "</w:t></w:p>")), "docx", 64) is None
    assert documents.extract("docx", b"not a zip") is None and documents.extract("docx", package(word__document_xml="<broken")) is None
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(PDF\\)) Tj T* [(W)-20(orld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\n"
    assert documents.extract("pdf", pdf) == "Hello (PDF)\nWorld" and documents.extract("pdf", b"%PDF-1.4 junk") is None
    assert documents.extract("txt", "é".encode()) == "é" and documents.extract("txt", b"a\0b") is None and documents.plain_text(b"abc", 2) is None
    df = spark.createDataFrame([("docx", docx), ("txt", b"plain"), ("txt", None)], "ext string, content binary")
    assert [r[0] for r in df.select(documents.extract_text("ext", "content")).collect()] == [text, "plain", None]
    cached = spark.createDataFrame([(f"/{i}", "x" * 10, i) for i in range(50)], "path string, text string, seq long")
    assert {r["seq"] for r in documents.within_cap(cached, 95).collect()} == set(range(41, 50)) and documents.within_cap(cached.limit(0), 5).count() == 0


def pdf(*objects):
    """A PDF file of (dictionary, stream) objects, numbered from 1; streams are packed."""
    out = b"%PDF-1.5\n"
    for i, (head, body) in enumerate(objects, 1):
        if body is None:
            out += b"%d 0 obj\n<< %s >>\nendobj\n" % (i, head)
        else:
            out += b"%d 0 obj\n<< %s /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (i, head, zlib.compress(body))
    return out + b"%%EOF"


def test_pdf_fonts_with_their_own_codes():
    """Two-byte codes by a font's table, single and in ranges; a second font without a table; fonts that lie in an object stream."""
    cmap = b"1 beginbfchar\n<0003> <0020>\nendbfchar\n2 beginbfrange\n<0010> <0012> <0041>\n<0020> <0021> [<00E9> <00660069>]\nendbfrange"
    page = b"BT /F1 12 Tf <001000110012> Tj <0003> Tj [<0020> -20 <0021>] TJ T* /F2 9 Tf (plain) Tj ET"
    direct = pdf((b"/Type /Page /Resources << /Font << /F1 2 0 R /F2 3 0 R >> >>", None), (b"/Type /Font /ToUnicode 4 0 R", None), (b"/Type /Font", None), (b"", cmap), (b"", page))
    assert documents.extract("pdf", direct) == "ABC éfi\nplain"
    first, second = b"<< /Type /Page /Resources << /Font 12 0 R >> >> ", b"<< /F1 13 0 R >> "
    table = b"11 0 12 %d 13 %d " % (len(first), len(first) + len(second))
    packed = pdf((b"/Type /ObjStm /N 3 /First %d" % len(table), table + first + second + b"<< /Type /Font /ToUnicode 2 0 R >>"), (b"", cmap), (b"", page.replace(b"/F2 9 Tf (plain) Tj ", b"")))
    assert documents.extract("pdf", packed) == "ABC éfi"
    odd = b"beginbfchar <01> <00411> <zz> <0042> endbfchar beginbfrange <05> <02> <0041> <0> <ff> <D800> endbfrange"
    documents.extract("pdf", pdf((b"/Type /Page /Resources << /Font << /F1 2 0 R >> >>", None), (b"/Type /Font /ToUnicode 3 0 R", None), (b"", odd), (b"", b"BT /F1 1 Tf <0102FF0> Tj ET")))
    for cut in range(0, len(direct), 7):
        documents.extract("pdf", direct[:cut])  # damaged files give some text or none, and no error


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("hello.txt", "first")
        f.writestr("nested/notes.md", "second entry")
        f.writestr("dir/", "")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for name, body in (("one.txt", b"5byte"), ("n" * 150 + ".txt", b"nine byte")):
            i = tarfile.TarInfo(name)
            i.size = len(body)
            f.addfile(i, io.BytesIO(body))
    df = spark.createDataFrame([("/a.zip", "zip", z.getvalue()), ("/b.tar", "tar", t.getvalue()), ("/c.7z", "7z", b"7z"), ("/d.zip", "zip", b"broken")], "path string, name_ext string, content binary")
    assert {(r["member"], r["size"], r["is_dir"]) for r in archives.list_members(df).collect()} == {("hello.txt", 5, False), ("nested/notes.md", 12, False), ("dir/", 0, True), ("one.txt", 5, False), ("n" * 150 + ".txt", 9, False)}
    assert {r["text"] for r in archives.member_texts(df).collect()} == {"first", "second entry", "5byte", "nine byte"}
    assert [n for n, _ in archives.contents(t.getvalue(), "tar", member=5)] == ["one.txt"]
    assert len(list(archives.contents(z.getvalue(), "zip", most=1))) == 1


def test_mounts(spark, tmp_path):
    f = tmp_path / "mounts"
    f.write_text("/dev/sdb1 /media/my\\040disk vfat rw 0 0\nproc /proc proc rw\nbad\n")
    rows = mounts.read_mounts(spark, str(f))
    assert {(r["device"], r["point"], r["fstype"]) for r in rows.collect()} == {("/dev/sdb1", "/media/my disk", "vfat"), ("proc", "/proc", "proc")}
    assert [r["point"] for r in mounts.removable_mounts(rows, ["sdb"]).collect()] == ["/media/my disk"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.commit() is None and c.needs_rebuild("k") and c.files().count() == 0
    c.rebuild(spark.createDataFrame([("/b", 1, 1, False), ("/a", 2, 1, False), ("/a", 2, 1, False), ("/d", 0, 1, True), ("/d/x", 3, 1, False)], ENTRY), "k")
    assert [(r["id"], r["path"]) for r in c.files().orderBy("id").collect()] == [(1, "/a"), (2, "/b"), (3, "/d"), (4, "/d/x")] and not c.needs_rebuild("k") and c.needs_rebuild("other")
    c.apply(spark.createDataFrame([("/d", "remove", None, None, None, 1), ("/new", "upsert", 7, 1, False, 2)], DELTA))
    assert {r["path"] for r in c.files().collect()} == {"/a", "/b", "/new"} and c.status()["dirty"] == 2
    assert not c.compact(5) and c.compact(1) and c.status()["dirty"] == 0 and c.commit()["version"] == 2
    assert {r["path"] for r in c.files().collect()} == {"/a", "/b", "/new"}
    c.add_texts(spark.createDataFrame([("/a", "old"), ("/gone", "x"), ("/b", "bee")], "path string, text string"), 1)
    c.add_texts(spark.createDataFrame([("/a", "fresh")], "path string, text string"), 2)
    assert {r["path"]: r["text"] for r in c.texts().collect()} == {"/a": "fresh", "/b": "bee"} and tuple(c.text_stats().first()) == (2, 8)
    assert c.drop_texts_under(spark.createDataFrame([("/b",)], "path string")).count() == 1


EVENTS = [("/w/new.txt", "create", 3, 1, False, 1), ("/w/inv.txt", "data", 9, 2, False, 2), ("/w/new.txt", "remove", None, None, None, 3), ("/w/d", "create", 0, 1, True, 4), ("/w/d/in.txt", "create", 1, 1, False, 5), ("/w/d", "rename_from", None, None, None, 6), ("/w/.sec", "create", 1, 1, False, 7), ("/o/x", "create", 1, 1, False, 8), ("/w/q", "access", 1, 1, False, 9), (None, "create", 1, 1, False, 10)]


def test_stream_equals_batch(spark, tmp_path):
    base = spark.createDataFrame([("/w/inv.txt", 1, 1, False)], ENTRY)
    c = Catalog(spark, str(tmp_path / "cat"))
    c.rebuild(base)
    src = tmp_path / "events"
    for i in range(0, len(EVENTS), 3):
        spark.createDataFrame(EVENTS[i : i + 3], EVENT).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(src))
    cdc.ingest(stream, c, str(tmp_path / "cp"), ["/w"]).awaitTermination()
    want = {(r["path"], r["size"]) for r in cdc.replay(spark.createDataFrame(EVENTS, EVENT).filter("path LIKE '/w%'"), base).collect()}
    assert {(r["path"], r["size"]) for r in c.entries().collect()} == want == {("/w/inv.txt", 9), ("/w/.sec", 1)}
    q = cdc.watch(stream, Query(name="*.txt"), 10).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["path"] for r in spark.table("seen").collect()} == {"/w/new.txt", "/w/inv.txt", "/w/d/in.txt"}


def test_watching_a_directory(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, {"a.txt": "1", "b.txt": "2"})
    q = walk.events(spark, walk.WalkOptions([str(root)])).writeStream.format("memory").queryName("walked").outputMode("append").trigger(processingTime="1 second").start()
    try:
        q.processAllAvailable()
        (root / "c.txt").write_text("3")
        (root / "a.txt").unlink()
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(os.path.basename(r["path"]), r["kind"]) for r in spark.table("walked").collect()} == {("a.txt", "create"), ("b.txt", "create"), ("c.txt", "create"), ("a.txt", "remove")}


def test_engine_and_command_line(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    tree(root, {"a/report.pdf": "x" * 50, "a/notes.md": "the needle is here\n", "b/three.txt": "t"})
    e = Engine(spark, str(tmp_path / "cat"), Config(roots=[str(root)])).start()
    assert e.count(Query()) == 5 and e.status()["files"] == 3 and e.status()["state"] == "Live"
    e.index_texts(str(root), 1)
    assert [os.path.basename(r["path"]) for r in e.search(Query(content="NEEDLE")).results.collect()] == ["notes.md"]
    answer = json.loads(handle(e, json.dumps({"op": "search", "query": json.loads(Query(name="*.pdf").to_json())})))
    assert [r["size"] for r in answer["results"]] == [50] and answer["indexed"] == 3 and not answer["truncated"]
    assert json.loads(handle(e, json.dumps({"op": "count", "query": json.loads(Query(name="a").to_json())})))["count"] == 1
    assert "error" in json.loads(handle(e, "nonsense")) and "error" in json.loads(handle(e, '{"op": "no"}'))
    assert json.loads(handle(e, json.dumps({"op": "set_config", "patch": {"exclude_dirs": [str(root / "a")], "nope": 1}})))["rebuilt"]
    assert e.count(Query()) == 2
    out = io.StringIO()
    assert main(["search", "three", "--catalog", str(tmp_path / "cat"), "--json"], spark, out) == 0 and json.loads(out.getvalue())["results"][0]["path"].endswith("three.txt")
    assert main(["search", "(", "--regex", "--catalog", str(tmp_path / "cat")], spark, out) == 1
    export.export(search.matching(e.catalog.files(), Query(), 10), str(tmp_path / "out"), "tsv")
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).columns == ["name", "path", "size", "modified"]
    conf = tmp_path / "c.json"
    e.config.save(str(conf))
    assert Config.load(str(conf)) == e.config and Config.load(str(tmp_path / "none")) == Config() and Config().patched({"follow_symlinks": "yes"}).follow_symlinks is False
