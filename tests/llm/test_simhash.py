"""SimHash: fingerprints, links and components against brute force."""

import random
import re

import pytest
from xxhash import xxh64_intdigest

from pathlake.llm import simhash
from pathlake.llm.components import connected_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(8)]
    out = [None, "", " \t\n", "One", "one", "one two", "ONE\x0btwo", "É é\xa0x y", "été " * 50]
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out + out[:12]


def test_fingerprint():
    for t in texts():
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    long = "ab cd " * 60_000
    assert simhash.fingerprint(long) == plain_fingerprint("ab cd " * 60_000)


def test_components_of_documents(spark, documents):
    t = texts()
    fps = [plain_fingerprint(x) for x in t]
    want = components(len(t), [(i, j) for i in range(len(t)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = simhash.near_duplicates(documents(t)).select("doc_id", simhash.hex16("fp").alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(t))}
    assert len(got) == len(t)
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("dense", [2, 64])
def test_links_are_complete(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    want = {tuple(sorted((signed[a], signed[b]))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_group_of_near_fingerprints_does_not_give_all_its_pairs(spark):
    """Hubs first, then links between what they left apart: the same components, few pairs."""
    rng = random.Random(6)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(120):
            x = c
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 3]
    root = components(len(signed), pairs)
    want = {signed[i]: signed[root[i]] for p in pairs for i in p}
    assert {r["node"]: r["root"] for r in simhash.roots_of(nodes).collect()} == want
    near = connected_components(simhash.hub_links(nodes), "a", "b")
    assert simhash.links(nodes, 3, near).count() < len(pairs) / 5


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(0, 0), (None, 4), (200, 201), (200, 201)]
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = components(300, real)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {n: want[n] for p in real for n in p}


def test_representatives_of_repeated_and_null_ids(spark, documents):
    """An id that stands on several texts takes none of them along."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(0, a), (1, b), (1, a), (None, a), (None, b + " and more words"), (None, None), (7, "")]
    kept = simhash.representatives(documents(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(0, a), (1, b), (None, b + " and more words"), (7, "")], key=str)
    assert simhash.representatives(documents([])).count() == 0
