"""Exact dedup: contract rows, ties, repeated rows, and a second batch."""

import hashlib
import re

from pathlake.llm.exact_dedup import DigestIndex, unique


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_one_batch(spark, documents):
    texts = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, "a \tb"), (7, None), (2, ""), (4, "\n "), (8, "\xa0"), (11, "x" * 200_000), (12, "x" * 200_000 + "\n"), (20, "same"), (20, "same")]
    got = DigestIndex(spark, "t_one", 4).add(documents(texts)).collect()
    assert len(got) == len(texts)
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    for r in got:
        t = next(t for i, t in texts if i == r["doc_id"])
        g = groups[norm(t)]
        assert r["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()
        assert (r["keep_id"], r["group_size"]) == (min(g)[1], len(g))
    assert sum(r["kept"] for r in got) == len(groups)
    assert sorted(r["kept"] for r in got if r["doc_id"] == 20) == [False, True]


def test_second_batch_is_held_against_the_index(spark, documents):
    index = DigestIndex(spark, "t_two", 4)
    index.add(documents([(1, "a"), (2, "b"), (3, "b ")])).collect()
    got = {r["doc_id"]: r for r in index.add(documents([(10, " a "), (11, "c"), (12, "c")])).collect()}
    assert {i: (r["keep_id"], r["kept"], r["group_size"]) for i, r in got.items()} == {10: (1, False, 2), 11: (11, True, 2), 12: (11, False, 2)}
    assert index.table().count() == 3
    plan = index.table().join(index.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_empty_table(spark, documents):
    assert DigestIndex(spark, "t_empty", 4).add(documents([])).count() == 0


def test_a_batch_may_be_added_again(spark, documents):
    """As by a retry after the index had grown: the same answer, and no second copy in the index."""
    index = DigestIndex(spark, "t_again", 4)
    old, new = documents([(1, "a"), (2, "b")]), documents([(3, "b"), (4, "c"), (5, "c ")])
    index.add(old, batch="one").collect()
    first = sorted(map(tuple, index.add(new, batch="two").collect()))
    again = sorted(map(tuple, DigestIndex(spark, "t_again", 99).add(new, batch="two").collect()))
    assert first == again and {r[0]: r[3] for r in first} == {3: False, 4: False, 5: True} and index.table().count() == 3
    assert {r["doc_id"] for r in unique(new, index, batch="two").collect()} == {5}
    # without a name, equal rows are the same batch
    other = documents([(8, "z"), (9, "z")])
    assert sorted(map(tuple, index.add(other).collect())) == sorted(map(tuple, index.add(other).collect()))
    # a session that does not know the table finds its files
    spark.sql("DROP TABLE t_again")
    assert [r["kept"] for r in DigestIndex(spark, "t_again", 16).add(documents([(70, "a")]), batch="three").collect()] == [False]
    index.drop()


def test_unique_keeps_rows_and_names_as_they_are(spark):
    """Repeated rows, null ids, text ids and columns that are called like our own."""
    rows = [("x", "a b", 1, "p"), ("x", "a b", 1, "p"), ("y", "ab", 2, None), (None, "c", 3, "q"), (None, "c ", 3, "q"), ("z", None, 4, "r"), ("w", "", 5, "s"), ("x", "other", 6, "t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __digest long, __n string")
    got = unique(docs, DigestIndex(spark, "t_names", 4))
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("x", "a b", 1, "p"), (None, "c ", 3, "q"), ("w", "", 5, "s"), ("x", "other", 6, "t")]))
    assert unique(docs.limit(0), DigestIndex(spark, "t_none", 4)).count() == 0


def test_the_query_holds_its_table_against_the_index(spark, documents, tmp_path):
    """The anti-join is there for an empty index too, and a second run of the query answers the same."""
    from pathlake.llm.queries import op5_exact_dedup

    documents([(1, "a"), (2, "a "), (3, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    for _ in range(2):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in op5_exact_dedup(spark, str(tmp_path)).collect()}
        assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}


def test_the_index_is_read_as_it_is_sorted(spark, documents, monkeypatch):
    """After three batches the anti-join sorts and shuffles the new batch alone; and merged generations answer as before."""
    from pathlake.llm import exact_dedup

    index = DigestIndex(spark, "t_sorted", 4).drop()
    monkeypatch.setattr(exact_dedup, "MERGE", 0)
    seen = set()
    for i in range(3):
        texts = [(100 * i + k, f"text {k * (i + 1)}") for k in range(50)]
        got = {r["doc_id"]: r["kept"] for r in index.add(documents(texts)).collect()}
        assert got == {k: t not in seen and next(j for j, u in texts if u == t) == k for k, t in texts}
        seen |= {t for _, t in texts}
    assert len(index.tables()) == 3 and index.table().count() == len(seen)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    batch = spark.createDataFrame([("a",), ("b",)], "text_sha256 string")
    plan = index.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Sort [text_sha256") == 1 and plan.count("Exchange") == 1, plan
    assert all(not r["kept"] for r in index.add(documents([(900, "text 0"), (901, "text 49")])).collect()) and len(index.tables()) == 3
    monkeypatch.setattr(exact_dedup, "MERGE", 100)
    assert [r["kept"] for r in index.add(documents([(902, "fresh"), (903, "text 1")])).orderBy("doc_id").collect()] == [True, False]
    assert len(index.tables()) == 1 and index.table().count() == len(seen) + 1
    monkeypatch.setattr(exact_dedup, "MERGE", 4)
    again = DigestIndex(spark, "t_sorted", 99)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again.add(documents([(904, "fresh"), (905, "newer"), (906, "text 98")])).collect()}
    assert got == {904: (902, False), 905: (905, True), 906: (149, False)} and len(again.tables()) == 2
    assert again.add(documents([(907, "newest")])).first()["kept"] and len(again.tables()) == 2 and again.table().count() == len(seen) + 3
    index.drop()
    assert index.add(documents([(1, "text 0")])).first()["kept"] and len(index.tables()) == 1
