"""The prefix trie against a plain one, with the sums taken node by node."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from pathlake.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    said = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    members, text, parent = collections.defaultdict(list), {}, {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = said.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
        node, above = (), (0, ())
        members[0, node].append((c, not seq))
        for d, said_now in enumerate(seq, 1):
            node = hashlib.sha256(repr((node, said_now)).encode()).digest()
            members[d, node].append((c, d == len(seq)))
            text[d, node], parent[d, node] = said_now[1], above
            above = (d, node)
    kids = collections.defaultdict(list)
    for k in members:
        if k[0]:
            kids[parent[k]].append(k)
    out = {}
    for k in sorted(members, key=lambda k: -k[0]):
        m = [c for c, _ in members[k]]
        saved = (len(m) - 1) * (len(text[k].encode()) if k[0] else 0) + sum(out[q][6] for q in kids[k])
        leaves = sum(out[q][5] for q in kids[k]) or 1
        ends = ",".join(map(str, sorted(c for c, e in members[k] if e)))
        up = min(c for c, _ in members[parent[k]]) if k[0] else None
        out[k] = (min(m), k[0], up, len(m), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def got(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


def odd_rows():
    """Nulls everywhere, ties, repeated rows, negative ids, families without a first, few different texts, one long conversation and its copies."""
    rnd = random.Random(5)
    rows = []
    for c in range(-12, 40):
        if c % 7 != 3:
            rows += [(c, rnd.choice([t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "", "é", None])) for t in range(rnd.choice([0, 1, 2, 5, 12]))]
    rows += [(None, 1, "user", "x")] * 3
    for c, turn_at in ((1000, 90), (1001, 95), (1002, 40), (1003, 10), (1004, 0)):
        rows += [(c, i, "user", "a" if i < turn_at else "b") for i in range(95)]
    rows += [(c, i, "user", "hot") for c in range(2000, 2300) for i in range(12)]
    return rows


@pytest.mark.parametrize("block", [4096, 4])
def test_against_a_plain_trie(spark, monkeypatch, block):
    """With blocks of 4 places and 8 ids, every conversation, path and group of members is cut."""
    monkeypatch.setattr(common, "SCAN", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 512 if block > 4 else 8)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS d", "3 AS `conv.x`", "4 AS saved").repartition(7)
    assert got(df) == plain(rows)


def test_a_comb_of_light_paths(spark):
    """Many levels: conversation i leaves a shared trunk after i turns. Ids are 5 apart, so none takes turns over from another."""
    rows = [(5 * i, t, "user", "t" if t < i else f"own {i}") for i in range(40) for t in range(41)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
