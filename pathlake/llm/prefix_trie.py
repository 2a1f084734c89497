"""The trie of conversations' prefixes, with sums over its subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns. Its key is its depth and a 128-bit digest: the exclusive or of its turns' digests, each mixed with its place,
so that prefixes of a long conversation are folded in blocks like any running sum. A node is named (conv_id, depth) by its smallest member: the nodes that
a conversation names are a chain, without gaps, down to its last turn.

Sums: each node's child with the most members (then the smallest conv_id) is heavy, and edges to other children are light. Nodes joined by heavy edges are
a path. A light child has at most half of its parent's members, so paths are taken by the logarithm of their top's members: a path's total is its own sum and
those of the light paths that hang on it, which are all of lower logarithms. Each round attaches paths to their parents. Then one suffix sum along each path gives every
subtree. Long paths and chains are scanned in blocks; hot parents are joined by broadcast; no group is held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlake.llm.common import checkpointed, lookup, placed, scanned, sha256_in_order

#: Turns that a conversation takes over at most, and conversations that share them.
MOST_SHARED, FAMILY = 8, 5
#: Members of a node whose ids are joined to one string before the digest.
CHUNK = 512


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, n_bytes): each conversation's turns in order, from 1, as digests.

    Ordered by turn (null first), then role and text, so ties and repeated rows have a defined place. Null roles and texts are empty. Rows without
    a conversation id belong to no conversation and aren't read. Other columns aren't read, whatever their names.
    """
    said = rows.select(
        rows[f"`{conv}`"].cast("long").alias("conv"),
        rows[f"`{turn}`"].alias("turn"),
        F.coalesce(rows[f"`{role}`"], F.lit("")).alias("role"),
        F.coalesce(rows[f"`{text}`"], F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")
    whole = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda at: F.conv(F.substring(whole, at, 16), 16, -10).cast("long")
    said = said.withColumns({"t1": half(1), "t2": half(17), "n_bytes": F.octet_length("text").cast("long")})
    return placed(said, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv", "t1", "t2", "n_bytes"])


def shared(conv: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return F.crc32(conv.cast("string")) % (MOST_SHARED + 1)


def rebuilt(said: DataFrame) -> DataFrame:
    """(conv, d, t1, t2, n_bytes, last): each conversation begins with the first turns of its family's first, conversation c - c % FAMILY; d counts from 1.

    A row with d = 0 stands for each conversation's empty prefix. said: turns(), stored."""
    n = said.groupBy("conv").agg(F.max("pos").alias("n"))
    base = n.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = n.withColumns({"h": shared(F.col("conv")), "base": F.col("conv") - F.col("conv") % FAMILY}).join(base, "base", "left")
    m = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = checkpointed(convs.select("conv", "base", "h", "n", m.alias("m"), (m + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    body = ["t1", "t2", "n_bytes"]
    heads = said.filter(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv", "base").join(convs, "base").filter("pos <= h")
    tails = lookup(said.filter(F.col("pos") > shared(F.col("conv"))), convs, "conv", "n", convs.agg(F.sum("n")).first()[0] or 0)
    tails = tails.withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    rows = [r.select("conv", F.col("pos").alias("d"), *body, (F.col("pos") == F.col("len")).alias("last")) for r in (heads, tails)]
    empty = convs.select("conv", F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(c) for c in body], (F.col("len") == 0).alias("last"))
    return rows[0].unionByName(rows[1]).unionByName(empty)


def prefixes(rows: DataFrame) -> DataFrame:
    """rebuilt() with p1, p2: the digest of the first d turns, and q1, q2: that of the first d - 1."""
    own = [F.when(F.col("d") > 0, F.xxhash64(F.lit(i), "d", "t1", "t2")).otherwise(0) for i in (1, 2)]
    rows = checkpointed(rows.select("conv", "d", "n_bytes", "last", own[0].alias("o1"), own[1].alias("o2")))
    out = scanned(rows, ["conv"], F.col("d"), {"p1": F.col("o1"), "p2": F.col("o2")}, F.bit_xor)
    return out.select("conv", "d", "n_bytes", "last", "p1", "p2", F.col("p1").bitwiseXOR(F.col("o1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("o2")).alias("q2"))


def _members(at: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256) of the nodes where conversations end. Their ids are dealt out by range and joined, CHUNK at a time, before the digest."""
    key = ["d", "p1", "p2"]
    ends = at.filter("last").select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    chunk = F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1)
    chunks = ends.withColumn("chunk", chunk).groupBy(*key, "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return sha256_in_order(chunks, key, "chunk", "ids", "ends_sha256", ",")


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node of the rebuilt conversations.

    An empty table has no nodes. What nulls, ties and repeated rows do is stated at turns().
    """
    at = checkpointed(prefixes(checkpointed(rebuilt(turns(rows, conv, turn, role, text)))))
    key = ["d", "p1", "p2"]
    nodes = at.groupBy(*key).agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        ((F.count("*") - 1) * F.min("n_bytes")).alias("saved"),
        F.min(F.struct("q1", "q2")).alias("q"),
    )
    nodes = checkpointed(nodes.withColumn("key", F.struct(*key)))
    n_rows = nodes.count()
    above = F.struct((F.col("d") - 1).alias("d"), F.col("q.q1").alias("p1"), F.col("q.q2").alias("p2"))
    below = nodes.filter("d > 0").drop("key").withColumn("key", above)
    named = lookup(below, nodes.select("key", F.col("conv").alias("up"), F.col("n_convs").alias("up_n")), "key", "up_n", n_rows).select("conv", "d", "up", "n_convs", "saved", *key[1:])
    root = nodes.filter("d = 0").select("conv", "d", F.lit(None).cast("long").alias("up"), "n_convs", "saved", *key[1:])
    tree = _pathed(checkpointed(named.unionByName(root)), n_rows)
    sums = _subtrees(tree)
    out = sums.join(_members(at), key, "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved_below").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _pathed(tree: DataFrame, n_rows: int) -> DataFrame:
    """tree (conv, d, up, n_convs, ...) with n_children, and path: the (conv, d) of the top of its heavy path.

    A run is a stretch of a path in one conversation's chain, found by one scan; runs are linked to paths by doubling.
    """
    kids = tree.filter("d > 0").groupBy(F.col("up").alias("conv"), (F.col("d") - 1).alias("d")).agg(
        F.count("*").alias("n_children"), F.max_by("conv", F.struct("n_convs", F.bitwise_not("conv"))).alias("heavy")
    )
    kids = checkpointed(kids)
    chosen = kids.select(F.col("heavy").alias("conv"), (F.col("d") + 1).alias("d"), F.lit(True).alias("is_heavy"))
    t = tree.join(kids.select("conv", "d", "n_children"), ["conv", "d"], "left").join(chosen, ["conv", "d"], "left")
    t = t.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "is_heavy": F.coalesce("is_heavy", F.lit(False))})
    t = checkpointed(t.withColumn("starts", F.col("up").isNull() | (F.col("up") != F.col("conv")) | ~F.col("is_heavy")))
    t = checkpointed(scanned(t, ["conv"], F.col("d"), {"run": F.when(F.col("starts"), F.col("d"))}, F.max))
    sizes = t.groupBy("conv", "run").agg(F.count("*").alias("n"))
    starts = t.filter("starts").select("conv", F.col("d").alias("run"), "up", "is_heavy")
    over = t.select(F.col("conv").alias("up"), (F.col("d") + 1).alias("run"), F.col("run").alias("up_run"))
    linked = starts.filter("is_heavy").join(over, ["up", "run"]).select("conv", "run", F.col("up").alias("hc"), F.col("up_run").alias("hd"), F.lit(False).alias("found"))
    tops = starts.filter("NOT is_heavy").select("conv", "run", F.col("conv").alias("hc"), F.col("run").alias("hd"), F.lit(True).alias("found"))
    runs = checkpointed(linked.unionByName(tops))
    while runs.filter("NOT found").limit(1).count():
        there = runs.select(F.col("conv").alias("hc"), F.col("run").alias("hd"), F.col("hc").alias("c"), F.col("hd").alias("d"), F.col("found").alias("f"))
        on = runs.filter("NOT found").drop("found").join(there, ["hc", "hd"]).select("conv", "run", F.col("c").alias("hc"), F.col("d").alias("hd"), F.col("f").alias("found"))
        runs = checkpointed(runs.filter("found").unionByName(on))
    ends = runs.join(sizes, ["conv", "run"]).select(F.struct("conv", "run").alias("r"), F.struct(F.col("hc").alias("conv"), F.col("hd").alias("d")).alias("path"), "n")
    out = lookup(t.withColumn("r", F.struct("conv", "run")), checkpointed(ends), "r", "n", n_rows)
    return checkpointed(out.drop("r", "run", "n", "starts"))


def _subtrees(tree: DataFrame) -> DataFrame:
    """tree with n_leaves and saved_below: sums over each node's subtree."""
    n_rows = tree.count()
    own = tree.groupBy("path").agg(F.sum("saved").alias("saved"))  # a path has one leaf, its last node
    tops = tree.filter((F.col("path.conv") == F.col("conv")) & (F.col("path.d") == F.col("d"))).select("path", "up", "d", "n_convs")
    light = tops.filter("d > 0").withColumn("node", F.struct(F.col("up").alias("conv"), (F.col("d") - 1).alias("d")))
    nodes = tree.filter("n_children > 1").select(F.struct("conv", "d").alias("node"), F.col("path").alias("above"), "n_children")
    light = lookup(light.drop("up", "d"), nodes, "node", "n_children", n_rows).select("path", "node", "above", "n_convs")
    root = tops.filter("d = 0").select("path", F.lit(None).cast(light.schema["node"].dataType).alias("node"), F.lit(None).cast(light.schema["above"].dataType).alias("above"), "n_convs")
    paths = light.unionByName(root).join(own, "path").withColumn("level", F.floor(F.log2("n_convs")))
    paths = checkpointed(paths.select("path", "node", "above", "saved", F.lit(1).cast("long").alias("leaves"), "level"))
    levels = sorted(r["level"] for r in paths.select("level").distinct().collect())  # at most 64
    total: list[DataFrame] = []
    hanging = None  # (above, saved, leaves): what is yet to be added to paths of higher levels
    for level in levels:
        now = paths.filter(F.col("level") == level).drop("level")
        if hanging is not None:
            more = hanging.select(F.col("above").alias("path"), F.col("saved").alias("s"), F.col("leaves").alias("n"))
            now = now.join(more, "path", "left").select("path", "node", "above", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("n", F.lit(0))).alias("leaves"))
        now = checkpointed(now)
        total.append(now)
        new = now.filter("above IS NOT NULL").groupBy("above").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        if hanging is not None:
            rest = hanging.join(now.select(F.col("path").alias("above")), "above", "left_anti")
            new = rest.unionByName(new).groupBy("above").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        hanging = checkpointed(new)
    hung = tree.sparkSession.createDataFrame([], "conv long, d long, s long, n long")
    for done in total:
        hung = hung.unionByName(done.filter("node IS NOT NULL").select("node.conv", "node.d", F.col("saved").alias("s"), F.col("leaves").alias("n")))
    hung = hung.groupBy("conv", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    rows = tree.join(hung, ["conv", "d"], "left").withColumns(
        {"s": F.col("saved") + F.coalesce("s", zero), "n": F.coalesce("n", zero) + F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")}
    )
    return scanned(checkpointed(rows), ["path"], -F.col("d"), {"saved_below": F.col("s"), "n_leaves": F.col("n")}, F.sum)
