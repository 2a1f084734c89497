"""The pipeline against a brute-force version of its filters, and the registered queries."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near import shingles, similar
from test_quality import plain_scores

import __spark_entry__
import corpus_pipeline
from pathlake.llm import quality
from pathlake.llm.common import id_hash, table


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("sf")), random.Random(3)
    vocabulary = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(" ".join(rng.choices(vocabulary, k=8)).capitalize() + "." for _ in range(n))
    item = " ".join(rng.choices(vocabulary, k=25))
    texts = [prose(rng.randint(5, 40)) for _ in range(150)]
    texts += ["### $$$ %%% " * 30 + str(i) for i in range(30)]
    texts += [texts[i].replace(" ", "\n") for i in range(5)] + [texts[0]] * 4
    texts += [t.replace(t.split(" ")[40], "zq", 1) for t in (prose(60) for _ in range(5)) for t in (t, t + " end")]
    texts += [f"{texts[20]} {item} {texts[21]}", None, ""]
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, item


def test_run_equals_brute_force(spark, tables):
    """Every stage in plain Python: scores of documents and sites, equal texts, five-word similarity of all pairs, every window against the item."""
    at, texts, item = tables
    model = quality.fit(table(spark, at, "documents"), table(spark, at, "labels"), id_hash(F.col("doc_id")) != 1)
    evidence = model.probability(quality.features(pa.array(texts, pa.string()))).tolist()
    score = plain_scores([(i, f"s{i % 4}", f"s{i % 4}/en") for i in range(len(texts))], evidence)
    left = {i for i, s in score.items() if s >= 0.5}
    assert not [i for i in left if "###" in (texts[i] or "")] and set(range(150)) <= left
    groups = {}
    for i in sorted(left):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append((-len(texts[i] or ""), i))
    left = sorted(min(g)[1] for g in groups.values())
    shingled = {i: shingles(texts[i]) for i in left}
    root = {i: i for i in left}
    for a in left:
        for b in left:
            if b < a and root[a] != root[b] and similar(shingled[a], shingled[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    left = [i for i in left if root[i] == i]
    want, n = shingles(item), len(item.split())

    def holds(text):
        w = (text or "").lower().split()
        windows = (shingles(" ".join(w[k : k + n])) for k in range(max(1, len(w) - n + 1)))
        return any(x and len(x & want) >= 0.8 * len(x | want) for x in windows)

    left = [i for i in left if not holds(texts[i])]
    got = corpus_pipeline.run(spark, at).collect()
    assert sorted(r["doc_id"] for r in got) == left and all(r["round_trip"] for r in got)
    assert len(left) < len(texts) - 45


def test_run_again_leaves_one_set_of_tables(spark, tables):
    from pathlake.sources.shared import shared_dir, subfolders

    at, _, _ = tables
    first = sorted(map(tuple, corpus_pipeline.run(spark, at).select("doc_id", "n_pieces").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).select("doc_id", "n_pieces").collect())) == first
    mine = [x for x in subfolders(spark, shared_dir(spark)) if x.startswith("pipeline-")]
    assert mine and all(len(subfolders(spark, f"{shared_dir(spark)}/{x}")) == 1 for x in mine)


def test_odd_rows_at_every_stage(spark, tables):
    """Null ids, texts, sources and languages, repeated rows, a very long text, columns called like our own: no stage fails, and columns stay as they are."""
    at, texts, _ = tables
    rows = [(None, texts[0], None, None, None, 1), (None, None, "en", "s", 0, 2), (1, texts[1], "en", "s", 1, 3), (1, texts[1], "en", "s", 1, 3), (2, "", None, "s", 0, 4), (3, " ".join(texts[2:40]) * 5, "en", "s", 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __digest long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, at)
        kept = got.collect()
        assert 1 <= len(kept) <= len(rows), name
        if name != "sentencepiece":
            assert got.columns == docs.columns and {tuple(r) for r in kept} <= set(rows), name


def test_stages_return_the_columns_of_documents(spark, tables):
    at, _, _ = tables
    docs = table(spark, at, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
