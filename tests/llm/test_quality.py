"""Quality: statistics, shrinkage against formulas, skewed and odd tables, accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathlake.llm import quality
from pathlake.llm.common import id_hash


def good(rng):
    return " ".join(" ".join(rng.choices(["the", "of", "stone", "river", "walked", "under", "light", "green"], k=9)).capitalize() + "." for _ in range(rng.randint(2, 20)))


def junk(rng):
    return rng.choice([" | ".join(rng.choices(["aa", "bb", "ccc"], k=60)), "BUY!! NOW!! " * 30, "it " * 200, "x### y$$$ z%%% " * 30])


def tables(spark, n=500):
    rng = random.Random(6)
    y = [int(rng.random() < 0.8) for _ in range(n)]
    docs = [(i, good(rng) if v else junk(rng), "en", "hot" if i % 3 == 0 else f"s{i % 40}", 0) for i, v in enumerate(y)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int"), y


def test_held_out_accuracy_and_filter(spark):
    docs, labels, y = tables(spark)
    model = quality.fit(docs, labels, id_hash(F.col("doc_id")) != 1, per_class=100)
    got = {r["doc_id"]: r for r in quality.score(docs, model, F.col("source"), F.col("lang")).collect()}
    assert np.mean([got[i]["quality_keep"] == bool(v) for i, v in enumerate(y)]) > 0.98
    assert all(got[i]["quality_keep"] for i, v in enumerate(y) if v)  # clean documents stay


def test_sites_shrink_to_the_prior(spark):
    rows = [("a", "a/1", 0.9)] * 50 + [("a", "a/2", 0.2)] * 50 + [("b", "b/1", 0.1)] + [("c", None, 0.8)] * 30 + [(None, None, 0.7)] * 10
    got = {(r["host"], r["path"]): r for r in quality.sites(spark.createDataFrame(rows, f"host string, path string, {quality.P} double")).collect()}
    mean = np.mean([r[2] for r in rows])
    assert all(abs(r["global_mean"] - mean) < 1e-9 for r in got.values())
    lone = got["b", "b/1"]
    assert 0.1 < lone["path_post"] and 0.1 < lone["host_post"] < mean  # a sparse site is drawn to the others
    assert abs(got["a", "a/1"]["path_post"] - 0.9) < abs(lone["path_post"] - 0.1)
    assert len(got) == 5


def test_odd_rows_and_names(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1, "k"), (1, None, None, None, 1, "k"), (2, "", "en", "s", 0, "v"), (None, good(random.Random(1)), "en", "s", 0, None)], "doc_id long, text string, lang string, source string, quality_score long, host string")
    model = quality.train([], {})
    out = quality.score(docs, model, F.col("source"), F.col("lang"))
    assert out.count() == 4 and out.columns[:5] == ["doc_id", "text", "lang", "source", "host"]
    assert {r["host"] for r in out.collect()} == {"k", "v", None}
    assert quality.score(docs.limit(0), model, F.col("source"), F.col("lang")).count() == 0


def test_columns_called_like_our_own(spark):
    docs = spark.createDataFrame([(1, good(random.Random(1)), "en", "s", 7, 8, 0.5, "g")], "doc_id long, text string, lang string, source string, __host long, __path long, __quality_evidence double, host_post string")
    row = quality.score(docs, quality.train([], {}), F.col("source"), F.col("lang")).first()
    assert (row["__host"], row["__path"], row["__quality_evidence"], row["host_post"]) == (7, 8, 0.5, "g") and 0 <= row["quality_score"] <= 1


def plain_scores(rows, probability):
    """{row: score} of (row, host, path) rows in plain Python: document evidence, hosts drawn to the mean, paths to their host, odds added."""
    p = dict(zip([r[0] for r in rows], probability))
    mean = sum(p.values()) / len(p)

    def drawn(groups, prior):
        n = {k: len(v) for k, v in groups.items()}
        m = {k: sum(v) / len(v) for k, v in groups.items()}
        total = sum(n.values())
        within = sum(sum((x - m[k]) ** 2 for x in v) for k, v in groups.items()) / max(1, total - len(n))
        between = (sum(n[k] * (m[k] - prior[k]) ** 2 for k in n) - (len(n) - 1) * within) / max(total - sum(x * x for x in n.values()) / total, 1e-9)
        strength = min(max((within + 1e-6) / max(between, 1e-9), 1.0), 1e6)
        return {k: (sum(v) + strength * prior[k]) / (n[k] + strength) for k, v in groups.items()}

    hosts, paths = {}, {}
    for i, h, q in rows:
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, q), []).append(p[i])
    host = drawn(hosts, dict.fromkeys(hosts, mean))
    path = drawn(paths, {k: host[k[0]] for k in paths})
    logit = lambda x: np.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    return {i: 1 / (1 + np.exp(-(logit(p[i]) + logit(path[h, q]) - logit(mean)))) for i, h, q in rows}


def test_query_equals_brute_force(spark, tmp_path):
    from pathlake.llm.queries import op6_quality

    docs, labels, y = tables(spark, 300)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = sorted((r for r in docs.collect()), key=lambda r: r["doc_id"])
    late = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    learn = [(r["text"], y[r["doc_id"]]) for r in sorted(rows, key=lambda r: str(r["doc_id"])) if r["doc_id"] not in late]
    model = quality.train(learn, {v: sum(1 for _, x in learn if x == v) for v in (0, 1)})
    want = plain_scores([(r["doc_id"], r["source"], f"{r['source']}/{r['lang']}") for r in rows], model.probability(quality.features(pa.array([r["text"] for r in rows]))).tolist())
    got = {r["doc_id"]: r for r in op6_quality(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and {i for i, r in got.items() if r["held_out"]} == late
    assert all(abs(got[i]["quality_score"] - want[i]) < 1e-6 and got[i]["quality_keep"] == (want[i] >= 0.5) for i in want)


def test_features_read_whole_texts():
    a = quality.features(pa.array(["ab cd. " * 400_000 + "!", None, "", "A B A A"]))
    assert a.shape == (4, quality.N_FEATURES) and abs(a[0, 0] - np.log1p(800_001)) < 1e-9 and (a[1] == a[2]).all() and a[0, 4] > 0
    assert a[3, 7] == 1 / 4 and a[3, 6] == 2 / 4
