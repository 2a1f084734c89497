"""The trigram filter: it leaves out no file with a match, and spares most files where a pattern is rare."""

import random
import re

import pytest

from pathlake.functions import paths
from pathlake.operators import search
from pathlake.plans.compiler import compile_query
from pathlake.plans.query import Query
from pathlake.sources import text_index
from pathlake.sources.text_index import TextIndex, required, slots

NOW = 2_000


def test_required_letters():
    for pattern, runs in {
        "license": ["license"],
        "a.*license+ed": ["license"],
        r"foo\.bar": ["foo.bar"],
        r"\bword\d{2}xyz": ["word", "xyz"],
        "colou?r": ["colo"],
        "abc{0,2}def": ["def"],
        "ab*cde": ["cde"],
        "@mail[0-9][.]example": ["@mail", "example"],
        "(abc)": [],
        "abc|def": [],
        "ab": [],
        "naïve": [],
        r"abc\Qdef": [],
        "[a&&[b]]cde": [],
        "[]x]cde": ["cde"],
        "^abc$": ["abc"],
        "": [],
        "abc\\": [],
    }.items():
        assert required(pattern) == runs, pattern


def test_a_match_has_the_required_trigrams():
    rnd = random.Random(4)
    letters = "abkKsſiİıIK éx.7"
    for _ in range(3_000):
        text = "".join(rnd.choices(letters, k=rnd.randrange(40)))
        pattern = "".join(rnd.choices("abksi .x7", k=4))
        if re.search(pattern, text, re.IGNORECASE):
            have = set(slots(text).tolist())
            assert all(set(slots(r).tolist()) <= have for r in required(pattern)), (pattern, text)
    assert len(slots("")) == len(slots("ab")) == 0


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    """600 texts in files of 20, with a rare word in some."""
    monkeypatch.setattr(text_index, "FILE_ROWS", 20)
    rnd = random.Random(2)
    words = ["".join(rnd.choices("aeioulnrst", k=rnd.randrange(2, 9))) for _ in range(400)]
    rows = [(f"/t/f{i:04}.txt", " ".join(rnd.choices(words, k=30)) + (" Zebra crossing" if i in (7, 8, 333) else "") + ("\nzebRa-ſTRipe" if i == 450 else "")) for i in range(600)] + [("/t/null.txt", None), ("/t/empty.txt", "")]
    texts = spark.createDataFrame(rows, "path string, text string")
    files = spark.createDataFrame([(i + 1, p, 1, 1, False) for i, (p, _) in enumerate(rows)], "id long, path string, size long, mtime long, is_dir boolean")
    return TextIndex(spark, str(tmp_path / "ix")).build(texts, "one"), texts, paths.derive(files)


@pytest.mark.parametrize(("pattern", "most"), [("zebra", 3), ("ZEBRA.*ing", 3), ("zebra-stripe", 1), ("no such words", 0), ("ze", None), ("(zebra)", None), ("e", None)])
def test_the_same_rows_from_fewer_files(index, pattern, most):
    ix, texts, files = index
    q = compile_query(Query(content=pattern, limit=10_000), NOW)
    want = sorted(r["path"] for r in search.content_matching(files, texts, q).collect())
    got = sorted(r["path"] for r in search.content_matching(files, ix.texts(q), q).collect())
    some = ix.files(pattern)
    assert got == want and (some is None) == (most is None)
    if most is not None:
        assert len(some) <= most and (want == [] or some)


def test_case_counts_where_it_should(index):
    ix, texts, files = index
    q = compile_query(Query(content="Zebra", case_sensitive=True), NOW)
    assert sorted(r["path"] for r in search.content_matching(files, ix.texts(q), q).collect()) == ["/t/f0007.txt", "/t/f0008.txt", "/t/f0333.txt"]


def test_another_key_makes_it_anew(spark, index):
    ix, texts, _ = index
    assert ix.build(texts.limit(0), "one").files("zebra") and ix.build(texts.filter("path = '/t/f0007.txt'"), "two").texts(compile_query(Query(content="zebra"), NOW)).count() == 1
    assert TextIndex(spark, ix.dir).build(texts.limit(0), "none").files("zebra") == []
