"""Chat formatting of reply trees.

Messages form trees (a message answers its parent). Iterative self-joins find each leaf's root by doubling: every
round, jumps reach twice as far up, so a tree of depth d takes log2(d) rounds. Branches are ranked by the sum of their
messages' scores. The nodes of the chosen ones are enumerated by the same jumps, the longest first, a row a node: what
is held grows with the messages, not with the square of a conversation. Each chosen path is formatted as one
conversation. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlake.llm.common import checkpointed

START, END = "<|start|>", "<|end|>\n"
#: Fixed escapes. Texts hold neither "<" nor "[" nor a single backslash after it, so neither this template's
#: marks nor those of others ("</s>", "[INST]", "<<SYS>>", "<|im_end|>") can appear inside a text.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\k"))


def _s(c: str | Column) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """The inverse of escape: pairs of backslashes are split off first, so that "\\\\l" is not read as an escape."""
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")),
    )
    return F.array_join(parts, "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(
        F.split(role, r"\\\\"),
        lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")),
    )
    return F.array_join(parts, "\\")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: (tree, node, parent, role, text, score), each turn the parent of the next.

    Turns are ordered by turn, then role, then text, so that ties and repeated rows have a defined place; null
    turns come first, null texts and roles count as empty, rows of a null conversation make one conversation.
    """
    r = rows.select(
        F.col(conv).alias("tree"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    w = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    node = F.row_number().over(w).cast("long")
    return r.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, pos, node) of the `top` best root-to-leaf paths of each tree, a row a node; pos counts from the root, 0.

    messages: tree, node, parent, score. A parent that is null or not in the tree makes a root. Of repeated
    (tree, node) rows one counts. A chain that runs into a cycle has no root and gives no path. Null scores count 0.
    Joins are on (tree, node), so a tree with a third of all rows spreads like any other; ranking keeps the best
    `top` of each task before it shuffles.
    """
    m = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), "parent")).alias("m"))
    m = checkpointed(m.select("tree", "node", F.col("m.parent").alias("parent"), F.col("m.s").alias("score")))
    known = m.select("tree", F.col("node").alias("up"), F.lit(1).alias("known"))
    jump = (
        m.alias("a")
        .join(known.alias("b"), _same("a", "b") & (F.col("a.parent") == F.col("b.up")), "left")
        .select("a.tree", "a.node", F.when(F.col("b.known") == 1, F.col("a.parent")).alias("up"), F.lit(1).cast("long").alias("n"), F.col("a.score").alias("score"))
    )
    jump = checkpointed(jump)
    inner = jump.filter("up IS NOT NULL").select("tree", "up").distinct()
    paths = checkpointed(jump.alias("a").join(inner.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.up")), "left_anti").select(F.col("a.node").alias("leaf"), "a.*"))
    most = m.count()
    reach, levels = 1, []
    # only what has not reached a root yet is joined again: long paths alone go into the later rounds
    while reach <= most and paths.filter("up IS NOT NULL").limit(1).count():
        levels.append((reach, jump.filter("up IS NOT NULL").select("tree", "node", "up")))
        paths = checkpointed(paths.filter("up IS NULL").unionByName(_farther(paths, jump, "leaf", "node")))
        jump = checkpointed(jump.filter("up IS NULL").unionByName(_farther(jump, jump, "node")))
        reach *= 2
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = paths.filter("up IS NULL").withColumn("rank", rank).filter(F.col("rank") <= top)
    steps = chosen.select("tree", "leaf", "rank", "score", F.col("n").alias("n_turns"), (F.col("n") - 1).alias("pos"), "node")
    for reach, up in reversed(levels):
        # what lies this far above the nodes so far; none of it is among them
        steps = checkpointed(steps)
        above = steps.alias("a").join(up.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.node")))
        above = above.select("a.tree", "a.leaf", "a.rank", "a.score", "a.n_turns", (F.col("a.pos") - reach).alias("pos"), F.col("b.up").alias("node"))
        steps = steps.unionByName(above)
    return steps


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def _farther(rows: DataFrame, jump: DataFrame, *keys: str) -> DataFrame:
    """The open rows (with an `up`), taken as much farther up as `jump` reaches from there."""
    return (
        rows.filter("up IS NOT NULL")
        .alias("a")
        .join(jump.alias("b"), _same("a", "b") & (F.col("a.up") == F.col("b.node")))
        .select("a.tree", *[f"a.{k}" for k in keys], "b.up", (F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.score") + F.col("b.score")).alias("score"))
    )


def format_branches(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, n_turns, formatted, loss_spans, turn_mask): each chosen path as one conversation.

    A turn is written as START role, newline, text, END, with role and text escaped. loss_spans lists
    (first, length), in code points from 1, of the texts of loss_role inside `formatted`. turn_mask has (loss, first, length) of each turn's text, counted from
    the turn's beginning, so that a long conversation's texts are found without counting from its own.
    Null roles and texts count as empty; an empty table gives no rows; other columns are not read.
    """
    steps = branches(messages, top)
    said = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    turns = (
        steps.alias("a")
        .join(said.alias("b"), _same("a", "b") & (F.col("a.node") == F.col("b.node")))
        .select("a.tree", "a.leaf", "a.rank", "a.score", "a.pos", F.col("b.m.role").alias("role"), F.col("b.m.text").alias("text"))
        .select("tree", "leaf", "rank", "score", "pos", (F.col("role") == loss_role).alias("loss"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    )
    # where each turn begins is a running sum, taken before turns are put together: lists would be copied at every turn
    path = ["tree", "leaf", "rank", "score"]
    size = F.lit(len(START) + 1) + F.char_length("role") + F.char_length("text") + F.lit(len(END))
    before = F.sum(size).over(Window.partitionBy(*path).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("at", F.coalesce(before, F.lit(0)).cast("int"))
    lists = turns.groupBy(*path).agg(F.sort_array(F.collect_list(F.struct("pos", "loss", "role", "text", "at"))).alias("t"))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")

    head = lambda t: F.lit(len(START) + 1) + F.char_length(t["role"])
    spans = F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct((t["at"] + head(t) + 1).alias("first"), F.char_length(t["text"]).alias("length")))
    mask = F.transform("t", lambda t: F.struct(t["loss"].alias("loss"), (head(t) + 1).alias("first"), F.char_length(t["text"]).alias("length")))
    return lists.select(*path, F.size("t").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"), mask.alias("turn_mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: what format_branches was given."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: F.length(p) > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def digest_columns(formatted: DataFrame) -> DataFrame:
    """What the query returns, read back from the formatted text and its loss mask."""
    turns = read_back(F.col("formatted"))
    # the turns as they are written, each with its mask
    written = F.arrays_zip(F.split("formatted", r"<\|end\|>\n").alias("w"), F.col("turn_mask").alias("m"))
    under = F.array_join(F.transform(F.filter(written, lambda z: z["m"]["loss"]), lambda z: unescape(F.substr(z["w"], z["m"]["first"], z["m"]["length"]))), "")
    rows = formatted.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), under.alias("loss"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
