"""Decontamination against brute force over all windows, and odd tables."""

import math
import random
import re
from collections import Counter

from pathlake.llm import decontaminate as dc

DOCS, BENCH = "doc_id long, text string, extra string", "item_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def shingles(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def brute(docs, bench, over_ends):
    """All (doc, item) with an item-sized window of weighted similarity 0.8 or more. Every window at every place is compared with every item; over_ends: also those that reach over an end of the text."""
    items = {i: shingles(words(t)) for i, t in bench if words(t)}
    n = {i: len(words(t)) for i, t in bench}
    df = Counter(s for x in items.values() for s in set(x))
    weight = lambda s: 1 / (1 + math.log(df[s])) if s in df else 1.0
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items.items():
            k, b = min(5, n[i]), Counter(s)
            for start in range(1 - n[i], len(w)) if over_ends else range(max(1, len(w) - n[i] + 1)):
                part = w[max(0, start) : start + n[i]]
                a = Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
                if not a.keys() & b.keys():
                    continue  # nothing in common: similarity 0
                own = lambda x: weight(x) if x in b else 1.0
                common = sum(own(x) * min(a[x], b[x]) for x in a)
                total = sum(own(x) * v for x, v in a.items()) + sum(own(x) * v for x, v in b.items()) - common
                if total and common / total >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), common / total)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = [(i, text(rng.choice([6, 15, 30, 58]))) for i in range(12)] + [(50, "only three words"), (51, ""), (52, None), (53, "one")]
    bench += [(60, "shared opening of many items here now " + text(10)), (61, "shared opening of many items here now " + text(10))]
    docs = []
    for d in range(60):
        w = text(rng.choice([0, 3, 40, 150])).split(" ")
        if d % 2:
            item = rng.choice(bench)[1] or ""
            x = item.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):  # an edited copy
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x if d % 4 == 1 else [y.upper() for y in x]
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(100, None), (101, ""), (102, "Only  three\nwords"), (103, bench[0][1]), (103, bench[0][1]), (None, bench[1][1]), (104, text(30_000) + " " + bench[2][1])]
    got = dc.contaminated(spark.createDataFrame([(*x, "x") for x in docs], DOCS), spark.createDataFrame(bench, BENCH)).collect()
    # windows are laid only where a shingle of the item stands: none that is similar is lost by it, nor by the radius
    least, most = (brute([x for x in docs if x[0] != 104], bench, over_ends) | {(104, 2): 1.0} for over_ends in (False, True))
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert set(least) <= set(found) <= set(most) and all(s <= most[k] + 1e-9 for k, s in found.items())
    assert len(got) == len(found) > 12 and all(r["hamming"] <= dc.RADIUS for r in got) and len(set(most) - set(least)) < 3
    by = {(r["doc_id"], r["item_id"]): r for r in got}
    assert by[104, 2]["start"] == 30_000 and by[103, 0]["similarity"] == 1.0


def test_several_passes_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(20))) for i in range(8)], BENCH)
    docs = spark.createDataFrame([(i, "x y " + " ".join(f"a{i}b{j}" for j in range(20)), "") for i in range(8)] + [(9, "clean words only", "")], DOCS)
    one = {tuple(r) for r in dc.contaminated(docs, bench).collect()}
    monkeypatch.setattr(dc, "PASS_SHINGLES", 40)
    assert {tuple(r) for r in dc.contaminated(docs, bench).collect()} == one and len(one) == 8
    assert [r["doc_id"] for r in dc.clean(docs, bench).collect()] == [9] and dc.clean(docs, bench).columns == docs.columns


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b", "")], DOCS), spark.createDataFrame([(1, "a b c d e f")], BENCH)
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 1


def test_null_and_repeated_ids_on_both_sides(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    bench = spark.createDataFrame([(None, a), (None, b), (7, c), (7, c), (8, c), (7, a)], BENCH)
    rows = [(None, "so " + a), (None, "clean words"), (1, "so " + b), (1, "clean too"), (2, c), (2, c), (3, None)]
    docs = spark.createDataFrame([(*x, "x") for x in rows], DOCS)
    got = dc.contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted([(None, None), (None, 7), (1, None), (2, 7), (2, 8)], key=str)
    assert all(r["similarity"] == 1.0 for r in got)
    assert {(r["doc_id"], r["text"]) for r in dc.clean(docs, bench).collect()} == {(None, "clean words"), (1, "clean too"), (3, None)}


def test_windows_just_over_the_similarity_are_found(spark):
    """One changed word in 50: similarity 0.804, at which a hundredth of the windows differ in more than 15 bits."""
    bench = [(i, " ".join(f"i{i}w{j}" for j in range(50))) for i in range(8)]
    docs = []
    for d in range(800):
        w = bench[d % 8][1].split(" ")
        w[5 + d // 8 % 40] = f"new{d}"
        docs.append((d, " ".join(w), ""))
    got = dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d % 8) for d in range(800)} and max(r["hamming"] for r in got) > 15


def test_near_copies_of_repeated_and_alike_items(spark):
    once, twice = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    alike = [" ".join([*(f"c{i}" for i in range(49)), f"end{k}"]) for k in range(6)]
    bench = [(0, once), (1, twice), (2, twice), (3, twice)] + [(10 + k, t) for k, t in enumerate(alike)]
    docs = [(0, once.replace("a20", "zq"), ""), (1, twice.replace("b20", "zq"), ""), (2, alike[0].replace("c20", "zq"), "")]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()}
    assert {(0, 0), (1, 1), (1, 2), (1, 3), (2, 10)} <= set(got) and all(abs(s - 41 / 51) < 1e-9 for k, s in got.items() if k[0] < 2)
