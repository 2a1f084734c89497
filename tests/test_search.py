"""Matching, search, counts and ranking over small catalogs."""

import pytest
from pyspark.sql import functions as F

from pathlake.functions import fuzzy, paths
from pathlake.operators import search
from pathlake.plans.compiler import compile_query
from pathlake.plans.patterns import PatternError
from pathlake.plans.query import Category, Query, QueryError
from pathlake.schema import ENTRY

NOW = 1_700_000_000


@pytest.fixture(scope="session")
def catalog(spark):
    def make(rows):
        df = spark.createDataFrame([r if isinstance(r, tuple) else (r, 1, NOW, False) for r in rows], ENTRY)
        return paths.derive(df.withColumn("id", F.monotonically_increasing_id()))

    return make


def names(df):
    return sorted(r["path"].rsplit("/", 1)[-1] for r in df.collect())


@pytest.fixture(scope="session")
def sample(catalog):
    return catalog(
        [
            ("/home/u/docs/report.pdf", 5000, NOW - 60, False),
            ("/home/u/docs/notes.md", 40, NOW - 90000, False),
            ("/home/u/docs/.secret.pdf", 10, NOW - 30, False),
            ("/home/u/docs/sub", 0, NOW - 30, True),
        ]
    ).cache()


def test_sample(sample):
    def find(**q):
        got = names(search.search(sample, Query(**q), now=NOW))
        assert search.count(sample, Query(**q), now=NOW).first()["n"] == len(got)
        return got

    assert find() == ["notes.md", "report.pdf", "sub"]
    assert len(find(include_hidden=True)) == 4
    assert tuple(search.counts(sample).first()) == (3, 1)
    assert find(name="*.pdf") == ["report.pdf"]
    assert find(name="!*.md") == ["report.pdf", "sub"]
    assert find(extensions=["pdf"]) == ["report.pdf"] and find(extensions=["md"]) == ["notes.md"]
    assert find(min_size=1000) == ["report.pdf"] and find(max_size=100) == ["notes.md"]
    assert find(modified_within_secs=3600) == ["report.pdf", "sub"]
    assert len(find(under="/home/u/docs")) == 3 and find(under="/home/u/doc") == [] and len(find(under="/")) == 3 and len(find(under="/home/u/docs/")) == 3
    assert names(search.matching(sample, Query(content="x"), NOW)) == ["notes.md", "report.pdf"]


MATCHES = [
    ({"name": "*.jpg|*.png"}, ["/a.jpg", "/a.png"], ["/a.gif"]),
    ({"name": "invoice 2025|2026"}, ["/invoice-2026-03.pdf", "/invoice-2025-03.pdf"], ["/receipt-2026.pdf", "/invoice-2024.pdf"]),
    ({"name": '"a|b"'}, ["/a|b.txt"], ["/a.txt"]),
    ({"name": "^(draft|final).pdf$", "regex_mode": True}, ["/draft.pdf", "/final.pdf"], ["/other.pdf"]),
    ({"name": "folder:docs"}, ["/home/a/docs/report.pdf"], ["/home/a/downloads/report.pdf"]),
    ({"name": "folder:docs"}, ["/srv/Docs/notes.txt"], []),
    ({"name": "parent:downloads"}, ["/home/a/downloads/x"], ["/home/a/downloads/old/report.pdf"]),
    ({"name": '"meeting notes"'}, ["/meeting notes.md"], ["/notes-meeting.md"]),
    ({"name": "*.pdf !draft"}, ["/report.pdf"], ["/draft.pdf", "/report.txt"]),
    ({"name": r"report[_-][0-9]{4}\.pdf$", "regex_mode": True}, ["/report_2024.pdf"], ["/report_2024.pdf.bak"]),
    ({"name": "README"}, ["/readme.md"], []),
    ({"name": "README", "case_sensitive": True}, ["/README"], ["/readme.md"]),
    ({"extensions": ["gz"]}, ["/report.tar.gz"], ["/report.gz.bak"]),
    ({"extensions": [" .PDF ", "Md", "pdf", "  ", "", ".txt"]}, ["/REPORT.PDF", "/a.md", "/b.txt"], ["/c.doc"]),
    ({"name": "mtn", "fuzzy": True}, ["/meeting-notes.md"], []),
    ({"name": "MTN", "fuzzy": True, "case_sensitive": True}, [], ["/meeting-notes.md"]),
    ({"name": "cb", "fuzzy": True}, [], ["/abc"]),
    ({"name": "mtn !tmp", "fuzzy": True}, ["/meeting-time-notes.md"], ["/meeting-tmp-notes.md"]),
    ({"name": "{a,b}.txt"}, ["/xa.txt", "/b.txt"], ["/c.txt"]),
    ({"name": "[!a]?.t*"}, ["/bc.txt"], ["/ac.txt", "/b.txt"]),
    ({"name": "a.b+(c)"}, ["/xa.b+(c)y"], ["/aXb+(c)"]),
    ({"name": "|"}, ["/any"], []),
    ({"name": '!"a b"'}, ["/ab"], ["/a b.txt"]),
    ({"name": "!a|b"}, ["/a", "/b"], ["/xa|b"]),
    ({"name": "u/doc", "full_path": True}, ["/home/u/docs/x"], ["/home/u/x"]),
    ({"name": r"\d$", "regex_mode": True}, ["/a1", "/a٣"], ["/a1b", "/a1\n"]),
    ({"name": "é"}, ["/é.txt"], ["/É.txt"]),
    ({"name": "file:"}, ["/a"], []),
]


@pytest.mark.parametrize(("query", "yes", "no"), MATCHES, ids=[str(i) for i in range(len(MATCHES))])
def test_names(catalog, query, yes, no):
    got = {r["path"] for r in search.matching(catalog(yes + no), Query(**query), NOW).collect()}
    assert got == set(yes)


def test_filters(catalog):
    rows = catalog([("/a9", 9, NOW + 100000, False), ("/a10", 10, NOW - 60, False), ("/a20", 20, NOW - 7200, False), ("/a21", 21, 0, False), ("/d15", 15, NOW, True)])
    assert names(search.matching(rows, Query(min_size=10, max_size=20), NOW)) == ["a10", "a20"]
    assert names(search.matching(rows, Query(modified_within_secs=3600, include_dirs=False), NOW)) == ["a10", "a9"]
    with pytest.raises(QueryError, match="10.*5"):
        compile_query(Query(min_size=10, max_size=5), NOW)
    compile_query(Query(min_size=7, max_size=7), NOW)
    with pytest.raises(PatternError):
        compile_query(Query(name="(", regex_mode=True), NOW)
    with pytest.raises(PatternError):
        compile_query(Query(content="("), NOW)
    hidden = catalog(["/home/u/.config/x", "/home/u/.git/config", "/home/u/docs", "/a/../b", "/a/./b"])
    assert names(search.matching(hidden, Query(), NOW)) == ["b", "docs"]


def test_categories(catalog):
    rows = catalog([("/a.PNG", 1, NOW, False), ("/big.bin", 2048, NOW - 99999, False), ("/main.rs", 1, 0, False), ("/note.md", 1, NOW - 60, False), ("/x.png", 0, NOW - 99999, True)])
    find = lambda *c: names(search.matching(rows, Query(category=Category(*c)), NOW))
    assert find("Images") == ["a.PNG", "x.png"] and find("Large", 1024) == ["big.bin"] and find("Recent", 3600) == ["a.PNG", "note.md"] and find("Code") == ["main.rs"] and find("Docs") == ["note.md"] and len(find("All")) == 5
    f = search.facets(rows, Query(), NOW, 3600, 1024, {"root": "/"}).first()
    assert (f["images"], f["large"], f["recent"], f["all"], f["root"]) == (2, 1, 2, 5, 5)


FUZZY = [("mtn", "meeting-notes.md", 52), ("note", "notes.txt", 90), ("note", "nqoqtqex.txt", 69), ("rep", "report.txt", 68), ("rep", "xrep.txt", 60), ("cb", "abc", None), ("", "abc", 0), ("n", "aN.txt", 24), ("[", "a[b", 16)]


def test_fuzzy_scores(spark):
    row = spark.range(1).select(*[fuzzy.score(F.lit(hay), needle).alias(f"c{i}") for i, (needle, hay, _) in enumerate(FUZZY)]).first()
    assert list(row) == [s for _, _, s in FUZZY]


def test_ranking(catalog):
    rows = catalog(["/xrep.txt", "/report.txt", "/rep", "/rep/z.txt"])
    assert [r["path"] for r in search.ranked(rows, Query(name="rep", fuzzy=True, limit=2), "fuzzy", now=NOW).collect()] == ["/rep", "/report.txt"]
    got = search.ranked(rows, Query(name="rep", full_path=True), now=NOW).select("path", "relevance", "match").collect()
    assert [r["path"] for r in got] == ["/rep", "/report.txt", "/xrep.txt", "/rep/z.txt"] and [r["relevance"] for r in got][0] == 100


@pytest.fixture(scope="session")
def texts(spark, catalog):
    t = {"/l.txt": "alpha\nbeta\ngamma\n", "/h.txt": "say HeLLo there", "/e.txt": "", "/n.bin": "early\0tardy", "/alpha-note.txt": "nothing interesting here", "/beta.txt": "a mention of alpha inside", "/gamma.txt": "unrelated", "/crlf.txt": "one\r\ntwo"}
    return catalog(list(t)).cache(), spark.createDataFrame(list(t.items()), "path string, text string").cache()


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"content": r"alpha\nbeta"}, []),
        ({"content": r"alpha\nbeta", "multiline": True}, ["l.txt"]),
        ({"content": "^gamma$"}, ["l.txt"]),
        ({"content": "hello"}, ["h.txt"]),
        ({"content": "hello", "case_sensitive": True}, []),
        ({"content": "early"}, ["n.bin"]),
        ({"content": "tardy"}, []),
        ({"content": "^$"}, []),
        ({"content": "^one.$"}, ["crlf.txt"]),
        ({"content": "alpha", "name": "alpha"}, []),
        ({"content": "alpha", "name": "alpha", "content_or_name": True}, ["alpha-note.txt", "beta.txt", "l.txt"]),
        ({"content": "unrel", "content_or_name": True}, ["gamma.txt"]),
        ({"content": ""}, ["alpha-note.txt", "beta.txt", "crlf.txt", "gamma.txt", "h.txt", "l.txt", "n.bin"]),
    ],
)
def test_content(texts, query, want):
    files, doc_text = texts
    assert names(search.search(files, Query(**query), doc_text, NOW)) == want
    assert search.count_content(files, Query(**query), doc_text, NOW).first()["n"] == len(want)


def test_limit_and_truncation(catalog, texts):
    rows = catalog(["/a1", "/a2", "/a3"])
    assert search.search(rows, Query(limit=0), now=NOW).count() == 1
    for limit, cut in ((2, True), (3, True), (4, False)):
        r = search.run(rows, Query(name="a", limit=limit), now=NOW)
        assert (r.truncated, r.results.count(), r.indexed) == (cut, min(limit, 3), 3)
    either = lambda n: search.run(texts[0], Query(name="alpha", content="alpha", content_or_name=True, limit=n), texts[1], NOW)
    assert not either(3).truncated and either(2).truncated
    assert names(search.within(rows, "A2")) == ["a2"]


def test_paths(spark):
    df = spark.createDataFrame([("/a", 1, 1, False), ("/a/b.tar.gz", 1, 1, False), ("/x/.bashrc", 1, 1, False), ("/x/name.", 1, 1, False), ("/d.PNG", 0, 1, True), ("/", 0, 0, True)], ENTRY)
    got = {r["path"]: (r["name"], r["dir"], r["ext"], r["name_ext"], r["is_hidden"], list(r["ancestors"])) for r in paths.derive(df).collect()}
    assert got["/a"] == ("a", "/", "", "", False, ["/", "/a"])
    assert got["/a/b.tar.gz"] == ("b.tar.gz", "/a", "gz", "gz", False, ["/", "/a", "/a/b.tar.gz"])
    assert got["/x/.bashrc"][2:5] == ("", "", True) and got["/x/name."][2] == "" and got["/d.PNG"][2:4] == ("", "png") and got["/"][0:2] == ("", "")


def test_plans_push_down(spark, sample, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    sample.write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    plan = search.matching(stored, Query(name="doc ext:pdf size:>1KB", under="/home"), NOW).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size,1025)" in plan and "PushedFilters" in plan and "ArrowEval" not in plan and "ancestors" not in plan
