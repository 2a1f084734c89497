"""Query text, sizes, ages, JSON: no session needed."""

import pytest

from pathlake.plans.patterns import PatternError, glob_regex, regex_body
from pathlake.plans.query import Category, Query, QueryError, cli_duration, cli_size, parse_age, parse_bytes, parse_size, parse_tokens, split_terms


def test_split_terms():
    assert split_terms('a "b c" d"e f"g  "open end') == [("a", False), ("b c", True), ("de fg", True), ("open end", True)]
    assert split_terms('  "" ') == []


def test_tokens():
    kept, t = parse_tokens("report ext:pdf,doc ext:;..md")
    assert [k for k, _ in kept] == ["report"] and t.extensions == ["pdf", "doc", "md"]
    _, t = parse_tokens("size:>1MB")
    assert (t.min_size, t.max_size) == (1048577, None)
    _, t = parse_tokens("size:1KB..2KB modified:today in:/var/log folder:docs")
    assert (t.min_size, t.max_size, t.modified_within_secs, t.under, t.folder) == (1024, 2048, 86400, "/var/log", "docs")
    kept, t = parse_tokens('size:big "ext:pdf" time:12:30 folder:"my docs" !ext:pdf EXT:pdf')
    assert [k for k, _ in kept] == ["size:big", "ext:pdf", "time:12:30", "folder:my docs", "!ext:pdf", "EXT:pdf"] and not t.extensions
    kept, t = parse_tokens("file: notes")
    assert t.files_only and kept == [("notes", False)]


@pytest.mark.parametrize(("text", "value"), [("10B", 10), ("2.5MB", 2621440), ("0.5b", 1), ("1 kb", 1024), ("7", 7), ("-1", None), ("nan", None), ("inf", None), ("", None), ("big", None), ("1TB", 1 << 40)])
def test_bytes(text, value):
    assert parse_bytes(text) == value


def test_sizes_and_ages():
    assert parse_size("<10B") == (None, 9) and parse_size("<0") == (None, 0) and parse_size(">=1KB") == (1024, None) and parse_size("5") == (5, 5)
    assert parse_size("1..") == (1, None) and parse_size("..") is None and parse_size("x..2") is None
    assert [parse_age(x) for x in ("today", "yesterday", "week", "thisweek", "month", "year", "12h", "3d", "2w", "5m", "3é", "")] == [86400, 172800, 604800, 604800, 2592000, 31536000, 43200, 259200, 1209600, None, None, None]
    assert [cli_size(x) for x in ("1024", "10K", "2M", "1G", " 3m ")] == [1024, 10240, 2 << 20, 1 << 30, 3 << 20]
    assert [cli_duration(x) for x in ("3600", "30m", "24h", "7d", "2w")] == [3600, 1800, 86400, 604800, 1209600]
    for f, x in ((cli_size, "10X"), (cli_size, ""), (cli_size, "99999999999999G"), (cli_duration, "7q")):
        with pytest.raises(QueryError):
            f(x)


def test_json():
    q = Query(name="a", category=Category("Recent", 5), extensions=["pdf"], content="x")
    assert Query.from_json(q.to_json()) == q
    old = '{"name":"n","regex_mode":false,"case_sensitive":false,"include_hidden":false,"full_path":false,"category":"All","include_dirs":true,"limit":5,"later":1}'
    assert Query.from_json(old) == Query(name="n", limit=5)
    for bad in ("{}", old.replace('"All"', '"Nope"'), old.replace('"All"', '{"Recent":{}}')):
        with pytest.raises(QueryError):
            Query.from_json(bad)


def test_patterns_that_do_not_compile():
    for glob in ("a{b", "a}b", "[a", "x\\", "[z-a]"):
        with pytest.raises(PatternError):
            glob_regex(glob)
    for regex in ("(", "a(?=b)", r"(a)\1", "a++", "(?<!x)y", "[z-a]", "*"):
        with pytest.raises(PatternError):
            regex_body(regex)
    assert regex_body(r"^a$|[$]\$") == r"^a\z|[$]\$"
