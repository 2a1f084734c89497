"""Chat formatting: round trips, loss masks and reply trees."""

import hashlib
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathlake.llm import chat_format as cf

CONV = "conv_id long, turn long, role string, text string, extra string"
MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def digest(rows):
    rows = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, rows):
    got = cf.digest_columns(cf.format_branches(cf.chains(spark.createDataFrame(rows, CONV)))).collect()
    want = {c: digest([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want
    assert len(got) == len(want)


def test_awkward_conversations(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"\\<[{t}</s>[INST]\\l\\k <|end|>\n\n", "x") for t in range(9)]
    rows += [(2, 0, None, None, None), (2, 0, "user", "b", None), (2, 0, "user", "a", None), (2, None, "assistant", "\U0001f600é", None)]
    rows += [(3, 5, "assistant", "", None), (3, 5, "assistant", "", None), (None, 1, "user", "no id", None), (4, 0, "a\nb\\n<", "x" * 100_000, None)]
    check(spark, rows)
    assert cf.format_branches(cf.chains(spark.createDataFrame([], CONV))).count() == 0


def test_marks_stay_out_of_texts(spark):
    rows = [(1, 0, "user", cf.START + cf.END + "</s>[INST] ok [/INST]", None)]
    text = cf.format_branches(cf.chains(spark.createDataFrame(rows, CONV))).first()["formatted"]
    assert text.count("<") == 2 and "[" not in text


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "\\", "\n"]), st.text(alphabet="\\<[lkn\n|>ae", max_size=12)), min_size=1, max_size=6), min_size=30, max_size=60))
def test_round_trip(spark, talks):
    check(spark, [(c, i, r, t, None) for c, turns in enumerate(talks) for i, (r, t) in enumerate(turns)])


def paths(df, top):
    """{(tree, rank): ([(pos, node)], score)} of all branches."""
    out = {}
    for r in cf.branches(df, top).collect():
        out.setdefault((r["tree"], r["rank"]), ([], r["score"]))[0].append((r["pos"], r["node"]))
        assert r["n_turns"] > r["pos"] >= 0
    return out


def test_reply_tree(spark):
    m = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.1)]
    m += [(2, 1, 99, "user", "lost parent", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (2, 1, 99, "user", "lost parent", None)]
    df = spark.createDataFrame(m, MESSAGES)
    got = {k: ([node for _, node in sorted(v)], score) for k, (v, score) in paths(df, 5).items()}
    assert got == {(1, 1): ([1, 2], 2.0), (1, 2): ([1, 3, 4, 5], 1.6), (2, 1): ([1], 0.0)}
    best = cf.format_branches(df).filter("tree = 1").first()
    assert best["formatted"] == f"{cf.START}user\nq{cf.END}{cf.START}assistant\ngood{cf.END}"
    first, length = best["loss_spans"][0]
    assert best["formatted"][first - 1 : first - 1 + length] == "good"


def test_deep_chain(spark):
    df = spark.range(1, 201).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.lit("t").alias("text"), F.lit(1.0).alias("score"))
    (steps, score), = paths(df, 1).values()
    assert sorted(steps) == [(i - 1, i) for i in range(1, 201)] and score == 200.0


def test_random_trees_equal_brute_force(spark):
    """All branches of random trees, their order of nodes, scores and ranks, against walks up from every leaf."""
    rng, rows, want = random.Random(4), [], {}
    for tree in range(12):
        n = rng.choice([1, 2, 7, 33, 64, 65])
        parent = {i: (rng.randrange(max(0, i - rng.choice([1, 3, 40])), i) if i else None) for i in range(n)}
        score = {i: rng.randrange(100) / 8 for i in range(n)}
        rows += [(tree, i, p, "user", "", score[i]) for i, p in parent.items()]
        found = []
        for leaf in set(parent) - set(parent.values()):
            path = [leaf]
            while parent[path[0]] is not None:
                path.insert(0, parent[path[0]])
            found.append((-sum(score[i] for i in path), leaf, path))
        want |= {(tree, k + 1): (path, -s) for k, (s, _, path) in enumerate(sorted(found)[:4])}
    got = {k: ([node for _, node in sorted(v)], score) for k, (v, score) in paths(spark.createDataFrame(rows, MESSAGES), 4).items()}
    assert got == want


def test_a_long_conversation_takes_rows_in_proportion(spark):
    """20,000 turns: one row a turn at any time, not one list of turns a turn."""
    n = 20_000
    df = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.lit("t").alias("text"), F.lit(0.0).alias("score"))
    r = cf.branches(df).agg(F.count("*"), F.count_distinct("pos"), F.sum(F.abs(F.col("pos") + 1 - F.col("node")))).first()
    assert tuple(r) == (n, n, 0)


def test_mask_and_spans_say_the_same(spark):
    rows = [(c, t, ("user", "assistant", "a\nb")[t % 3], f"<é[{t}\\" * (t % 4), None) for c in range(5) for t in range(9)]
    out = cf.format_branches(cf.chains(spark.createDataFrame(rows, CONV))).collect()
    for r in out:
        pieces, at = r["formatted"].split(cf.END), 0
        spans = []
        for piece, m in zip(pieces, r["turn_mask"]):
            if m["loss"]:
                spans.append((at + m["first"], m["length"]))
                assert piece[m["first"] - 1 : m["first"] - 1 + m["length"]] == r["formatted"][spans[-1][0] - 1 : sum(spans[-1]) - 1]
            at += len(piece) + len(cf.END)
        assert spans == [tuple(s) for s in r["loss_spans"]] and len(r["turn_mask"]) == 9


def test_time_grows_with_the_turns(spark):
    """50,000 turns of one conversation; at a list that is copied at each turn they would take minutes."""
    n = F.col("id")
    said = spark.range(50_000).select(F.lit(1).cast("long").alias("conv_id"), n.alias("turn"), F.when(n % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn é <"), n.cast("string")).alias("text"))
    began = time.monotonic()
    r = cf.digest_columns(cf.format_branches(cf.chains(said))).first()
    loss = "".join(f"turn é <{i}" for i in range(1, 50_000, 2))
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (50_000, len(loss), hashlib.sha256(loss.encode()).hexdigest()) and time.monotonic() - began < 90
