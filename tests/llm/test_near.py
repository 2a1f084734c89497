"""Near-dedup at a five-word similarity of 0.8 against brute force."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from pathlake.llm import near
from pathlake.llm.components import order


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def brute(sets):
    """The least number of each set's component."""
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_edited_copies_equal_brute_force(spark, documents):
    """A few changed words in 100 to 400: one fingerprint within 3 bits links a minority of these."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "one two", "One  two", "one three"]
    for size, edits in [(100, 1), (100, 2), (200, 3), (400, 4), (400, 7), (400, 9), (60, 3)] * 6:
        base = rng.choices(vocabulary, k=size)
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    want = brute([shingles(t) for t in texts])
    got = {r["doc_id"]: r["least"]["doc_id"] for r in near.components(documents(texts)).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts) - 60
    kept = near.representatives(documents(texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))


def test_chains_in_one_bucket(spark, documents):
    """Members of one bucket that are far from its pivot and near each other are still linked."""
    words = [f"v{i}" for i in range(300)]
    texts = [" ".join(words[:k] + [f"u{j}" for j in range(300 - k)]) for k in range(120, 301, 12)]
    want = brute([shingles(t) for t in texts])
    got = {r["doc_id"]: r["least"]["doc_id"] for r in near.components(documents(texts)).collect()}
    assert got == dict(enumerate(want))


def test_repeated_and_null_ids(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(None, a), (None, b), (1, b + " more"), (1, c), (2, c + " more")]
    kept = near.representatives(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, a), (1, b + " more"), (1, c)], key=str)
    assert near.representatives(documents([])).count() == 0


def test_a_large_group_of_edited_copies(spark, documents):
    """Copies with many edits fall into each other's buckets without being similar: the classes are brute force's, and few pairs are looked at."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            w[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    want = brute([shingles(t) for t in texts])
    docs = documents(texts)
    got = {r["doc_id"]: r["least"]["doc_id"] for r in near.components(docs).collect()}
    assert got == dict(enumerate(want)) and 10 < len(set(want)) < 300


def test_shuffles_of_earlier_steps_are_removed(spark, documents):
    """Their files stayed until the driver collected its garbage: on 211 partitions more than four times the input."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choices(vocabulary, k=80) for _ in range(60)]
    docs = documents([" ".join(w[:i] + ["zz"] + w[i:]) for w in base for i in (0, 40)]).cache()
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName().split("_")[1] for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}
    docs.count()
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    was = spark.conf.get(key)
    found = near.components(docs)
    for _ in range(50):  # they go in the background
        if len(left := shuffles() - before) <= 2:
            break
        time.sleep(0.1)
    assert len(left) <= 2 and spark.conf.get(key) == was
    assert len({r["least"]["doc_id"] for r in found.collect()}) == 60


def test_pairs_of_unlike_sizes_are_not_compared(spark, documents, monkeypatch):
    """A text and its first 70 % meet in tables, and can't be similar."""
    rng = random.Random(12)
    base = [[f"t{rng.randrange(4000)}" for _ in range(150)] for _ in range(20)]
    texts = [" ".join(w[:k] + more) for w in base for k, more in ((150, []), (150, ["z"]), (105, []), (105, ["z"]))]
    size = {near.set_digest(x) - (1 << 64) * (near.set_digest(x) >> 63): len(x) for x in map(near.shingle_set, texts)}
    seen, plain = [], near.within
    monkeypatch.setattr(near, "within", lambda pairs, prints: (seen.extend((r["a"], r["b"]) for r in pairs.collect()), plain(pairs, prints))[1])
    got = {r["doc_id"]: r["least"]["doc_id"] for r in near.components(documents(texts)).collect()}
    assert got == {i: i - i % 2 for i in range(80)}
    assert seen and all(10 * min(size[a], size[b]) >= 8 * max(size[a], size[b]) for a, b in seen)


def test_values_of_pairs_with_a_hot_member(spark):
    """Each pair once with both values, whether its b is in a few pairs or in thousands."""
    of = spark.range(3000).select(F.col("id").alias("sig"), (F.col("id") * 7).alias("v"))
    pairs = spark.range(1, 3000).selectExpr("id a", "CASE WHEN id % 3 = 0 THEN id - 1 ELSE 0 END b")
    got = sorted(map(tuple, near._both(near.checkpointed(pairs), of, "v").collect()))
    assert got == sorted((a, b, 7 * a, 7 * b) for a in range(1, 3000) for b in [a - 1 if a % 3 == 0 else 0])


def test_candidates_lose_no_pair(spark):
    """Against all pairs of sets, around the similarity and with sizes at its bound."""
    rng = random.Random(7)
    base = list(range(40))
    sets = [set(base[: rng.randint(28, 40)]) | set(rng.sample(range(100, 160), rng.randint(0, 9))) for _ in range(160)]
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "sig long, shingles array<long>")
    members = spark.createDataFrame([(i, i // 3, len(x)) for i, x in enumerate(sets)], "sig long, root long, n long")
    found = {frozenset(r) for r in near.candidates(members, rows).collect()}
    links = {frozenset((i, j)) for i in range(160) for j in range(i) if i // 3 != j // 3 and similar(sets[i], sets[j])}
    assert links and links <= found and all(len({i // 3 for i in pair}) == 2 for pair in found)


def test_fingerprint_is_a_simhash():
    """A bit is 1 if it is in over half of the hashes of the set's shingles."""
    mask = (1 << 64) - 1

    def word(h, k):
        h = h + k * 0x9E3779B97F4A7C15 & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return (h ^ h >> 31).to_bytes(8, "little")

    for n in (0, 1, 2, 7, 255, 600):
        x = near.shingle_set(" ".join(f"w{i}" for i in range(n + 4 if n else 0)))
        rows = [b"".join(word(int(h), k) for k in range(1, near.BITS // 64 + 1)) for h in x]
        plain = [int(2 * sum(r[i // 8] >> 7 - i % 8 & 1 for r in rows) > len(rows)) for i in range(near.BITS)]
        assert len(x) == n and near.fingerprint(x).tolist() == plain


def test_the_index_finds_pairs_at_the_similarity():
    """Sets of similarity 0.8 agree in a table and are within the radius; unrelated ones hardly ever agree and are far apart."""
    rng = np.random.default_rng(4)
    for texts in (20, 1_000, 100_000):
        index, met = near.tables(texts), 0
        for n in (18, 36, 360):
            for _ in range(40):
                u = rng.integers(0, 1 << 64, n // 9 * 10, np.uint64)
                a, b, other = (near.fingerprint(x) for x in (u[: n], u[n // 9 :], rng.integers(0, 1 << 64, n, np.uint64)))
                assert (near.table_keys(a, index) == near.table_keys(b, index)).any() and (a != b).sum() <= near.RADIUS
                met += (near.table_keys(a, index) == near.table_keys(other, index)).sum()
                assert (a != other).sum() > 2 * near.RADIUS
        assert met <= 120 * len(index) / 2 ** (index.shape[1] - 3)


def test_texts_left_out_before_fingerprints_are_similar_to_none(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(300)]
    sets = []
    for _ in range(60):
        at, n = rng.randrange(150), rng.choice([1, 4, 5, 8, 9, 10, 12, 15, 40, 99, 110, 150])
        x = base[at : at + n]
        sets += [x, x[: max(1, n * 8 // 10)], x[: n - n // 18] + [rng.getrandbits(63) for _ in range(n // 9)]]
    sets += [[rng.getrandbits(63) for _ in range(50)] + base[:5] for _ in range(40)]
    sets = [np.unique(np.array(x, np.uint64)) for x in sets]
    sets = list({x.tobytes(): x for x in sets}.values())
    rows = spark.createDataFrame([(i, i, i, len(x), [int(h) for h in near.least_shingles(x)]) for i, x in enumerate(sets)], "doc_id long, th long, sig long, n long, prefix array<long>")
    nodes = rows.select("sig", order("doc_id").alias("best"), F.lit(1).alias("copies"), "n")
    kept = {r["sig"] for r in near.paired(rows, nodes).collect()}
    plain = [set(x.tolist()) for x in sets]
    want = {i for i, x in enumerate(plain) if any(i != j and similar(x, y) for j, y in enumerate(plain))}
    assert want <= kept and len(kept) < len(sets) - 30
