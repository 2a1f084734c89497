"""Toxicity: gradients against differences, windows, accuracy on rows that were not learned from, odd texts."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlake.llm import toxicity as tx
from pathlake.llm.common import held_out, id_hash

BAD = ["grotty", "vilest", "scummy"]


def make(rng, toxic, n=None):
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(n or rng.randint(5, 120))]
    if toxic:
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    y = [int(rng.random() < 0.25) for _ in range(420)]
    return [make(rng, v) for v in y], y


@pytest.fixture(scope="module")
def net(rows):
    return tx.train(list(zip(*rows))[:300], {0: 300, 1: 100}, epochs=8)


def test_gradients():
    rng = np.random.default_rng(0)
    net = tx.train([(make(random.Random(i), i % 2, 12), i % 2) for i in range(20)], {0: 10, 1: 10}, epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w, codes, lengths = tx.encode([b"aa grotty bb", b"one two three four " * 9])
    index, _ = tx.window_index(codes, lengths)
    y, weight = np.array([1.0] + [0.0] * (len(index) - 1)), np.ones(len(index))

    def loss():
        x, _ = net.inputs(w)
        z = net.forward(index, x).astype(float)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    x, side = net.inputs(w)
    g = net.gradients(index, x, side, y, weight)
    for k in ("W", "U", "v", "o", "b", "c"):
        flat = net.p[k].reshape(-1)
        for i in rng.integers(len(flat), size=4):
            old, h = flat[i], 3e-3
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * h) - g[k].reshape(-1)[i]) < 2e-3 + 0.05 * abs(g[k].reshape(-1)[i]), k


def test_windows_cover_everything():
    for n in (0, 1, 23, 24, 25, 36, 37, 500):
        index, count = tx.window_index(np.arange(n), np.array([n]))
        assert len(index) == count[0] >= 1 and set(index[index >= 0]) == set(range(n))
        if n > tx.WINDOW:
            assert (np.diff(index[:, 0]) == tx.STRIDE).all()


def test_held_out_accuracy(spark, documents, rows):
    texts, y = rows
    docs = documents(texts)
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    net = tx.fit(docs, labels, id_hash(F.col("doc_id")) != 1)
    got = {r["doc_id"]: r for r in tx.score(docs, net).withColumn("h", held_out(F.col("doc_id"))).collect()}
    late = [i for i in range(len(y)) if got[i]["h"]]
    assert np.mean([got[i]["predicted"] == y[i] for i in late]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_long_and_odd_texts(spark, documents, net):
    rng = random.Random(8)
    clean = make(rng, 0, 20_000)
    late = clean + " " + " ".join(BAD)  # the last window decides
    got = {r["doc_id"]: r for r in tx.score(documents([None, "", " \n", clean, late, late, "x" * 50_000, "GROTTY vilest, scummy!"]), net).collect()}
    assert got[3]["predicted"] == 0 and got[4]["predicted"] == 1 and got[4]["score"] == got[5]["score"] and got[0]["predicted"] == got[1]["predicted"] == 0 and got[7]["predicted"] == 1
    assert tx.score(documents([]), net).count() == 0 and tx.score(documents(["a"]), None).first()["score"] == 0.0
    assert tx.train([("a", 1)] * 20, {1: 20}) is None


def plain_score(net, text):
    """One text's score, window by window, word by word and unit by unit, in plain Python floats."""
    words = text.encode().lower().split()
    sig = lambda x: 1 / (1 + math.exp(-min(max(x, -500), 500)))
    p = {k: v.astype(float) for k, v in net.p.items()}

    def vector(w):
        bare = w.strip(tx.EDGE) or w
        code = zlib.crc32(bare)
        c = [32, *bare, 32]
        slots = []
        for i in range(len(c) - 2):
            h = (c[i] * 0x9E3779B1 ^ (c[i + 1] * 0x85EBCA6B + (c[i + 2] << 9))) & 0xFFFFFFFF
            slots.append(((h ^ h >> 15) * 0xC2B2AE35 & 0xFFFFFFFF) >> 19)
        odds = [float(net.char_odds[k]) for k in slots]
        return [*p["E"][code & (tx.WORD_SLOTS - 1)], *np.mean([p["C"][k] for k in slots], axis=0), float(net.word_odds[code & (tx.ODDS_SLOTS - 1)]), max(odds), sum(odds) / len(odds)]

    def logit(window):
        n, hid = len(window), tx.HIDDEN
        both = [[0.0] * (2 * hid) for _ in range(n)]
        for d in range(2):
            h = [0.0] * hid
            for t in range(n) if d == 0 else range(n - 1, -1, -1):
                x = vector(window[t])
                g = [sum(x[i] * p["W"][i][d * 3 * hid + j] for i in range(len(x))) + p["b"][d * 3 * hid + j] for j in range(3 * hid)]
                a = [sum(h[i] * p["U"][d][i][j] for i in range(hid)) for j in range(3 * hid)]
                z = [sig(g[j] + a[j]) for j in range(hid)]
                r = [sig(g[hid + j] + a[hid + j]) for j in range(hid)]
                c = [math.tanh(g[2 * hid + j] + r[j] * a[2 * hid + j]) for j in range(hid)]
                h = [c[j] + z[j] * (h[j] - c[j]) for j in range(hid)]
                both[t][d * hid : (d + 1) * hid] = h
        if not n:
            return float(p["c"][0])
        att = [sum(s[j] * p["v"][j] for j in range(2 * hid)) for s in both]
        e = [math.exp(x - max(att)) for x in att]
        pooled = [sum(e[t] * both[t][j] for t in range(n)) / sum(e) for j in range(2 * hid)]
        return sum(pooled[j] * p["o"][j] for j in range(2 * hid)) + float(p["c"][0])

    begins = [0]
    while begins[-1] + tx.WINDOW < len(words):
        begins.append(begins[-1] + tx.STRIDE)
    worst = max(logit(words[b : b + tx.WINDOW]) for b in begins)
    a, b, c = net.calibration
    return min(max(sig(a * min(max(worst, -15), 15) + b * math.log(len(begins)) + c), 1e-4), 1 - 1e-4)


def test_query_equals_brute_force(spark, documents, tmp_path):
    """Every row of the registered query against the plain version, with the network of the rows that may be learned from."""
    from pathlake.llm.queries import op7_toxicity

    rng = random.Random(8)
    y = [int(rng.random() < 0.4) for _ in range(90)]
    texts = [make(rng, v) for v in y] + [None, "", "one", "A " * 25, "b " * 24, "Grotty!! " + "c " * 60]
    documents(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    late = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = [(texts[i], y[i]) for i in sorted((i for i in range(90) if i not in late), key=str)]
    net = tx.train(rows, {v: sum(1 for _, x in rows if x == v) for v in (0, 1)})
    got = {r["doc_id"]: r for r in op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and {i for i, r in got.items() if r["held_out"]} == late
    for i, t in enumerate(texts):
        want = plain_score(net, t or "")
        assert abs(got[i]["score"] - want) < 2e-3, (i, t, got[i], want)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)
