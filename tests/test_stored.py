"""Registered queries over the stored catalog: what they read, and when it is built."""

import re

import pytest
from pyspark.sql import functions as F

from pathlake import catalogue
from pathlake.operators import duplicates
from pathlake.plans.query import Query


@pytest.fixture
def folder(spark, tmp_path):
    def make(n, mode="overwrite"):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 60 * 40).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(0).cast("long").alias("n_chars"))
        rows.write.mode(mode).parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_name_queries_read_no_text_and_push_their_filters(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    at = folder(400)
    for name in ("search_flagship", "filter_size", "filter_ext", "count_query", "facets", "sort_size_topk"):
        plan = plan_of(catalogue.QUERIES[name](spark, at))
        assert "text" not in plan and "documents.parquet" not in plan and "snapshots" in plan, name
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(catalogue.QUERIES["search_flagship"](spark, at)))[1]
    assert all(x in pushed for x in ("GreaterThanOrEqual(size,1025)", "In(ext, ", "is_dir")), pushed


def test_the_catalog_is_built_again_when_the_documents_change(spark, folder):
    at = folder(50)
    assert catalogue.files(spark, at).filter("NOT is_dir").count() == 50
    assert catalogue.stored(spark, at).commit()["version"] == catalogue.stored(spark, at).commit()["version"] == 1
    folder(80)
    assert catalogue.files(spark, at).filter("NOT is_dir").count() == 80 and catalogue.stored(spark, at).commit()["version"] == 2


def test_few_candidates_go_to_the_texts(spark, folder):
    at = folder(300)
    df = catalogue.search.content_matching(catalogue.files(spark, at), catalogue.corpus(spark, at).select("path", "text"), Query(name="doc-12", content="x"), catalogue.NOW)
    plan = plan_of(df)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and df.count() > 0


def test_duplicates_by_column_and_by_table_are_the_same(spark, folder):
    at = folder(200)
    by_table = duplicates.duplicate_members(catalogue.files(spark, at), catalogue.corpus(spark, at).select("path", "text"))
    by_column = duplicates.duplicate_members(catalogue.live(spark, at), "text")
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, by_column.collect())) and by_table.count() > 100


def test_streams_may_be_run_again(spark, tmp_path):
    """A query over streams begins anew each time: what its last run left is removed."""
    rows = [(i, f"2024-01-01 00:00:{i:02}", i % 10, ("signup", "error", "view")[i % 3]) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").write.parquet(str(tmp_path / "e"))
    part = next(f for f in (tmp_path / "e").iterdir() if f.suffix == ".parquet")
    (tmp_path / "sf").mkdir()
    spark.read.parquet(str(part.parent)).coalesce(1).write.parquet(str(tmp_path / "sf" / "one"))
    next(f for f in (tmp_path / "sf" / "one").iterdir() if f.suffix == ".parquet").rename(tmp_path / "sf" / "events.parquet")
    for name in ("stream_cdc", "stream_watch_new", "stream_extract"):
        first, again = (sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path / "sf")).collect())) for _ in range(2))
        assert first == again and first, name
