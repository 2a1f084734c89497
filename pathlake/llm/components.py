"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlake.llm.common import BROADCAST_ROWS, checkpointed, lookup


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge: root is the smallest node reachable.

    Each round joins every node with its smallest neighbour, in number of edges never more than before,
    and is written to the shared folder; it ends when a round changes nothing, after about log(n) rounds.
    A node with very many edges, as the root of a giant component, fills a partition of the join alone; that is a skewed one, which the planner splits,
    as its other side is one row. Nodes may have any type that has an order. Null nodes and loops are left out.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(least).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def order(id_: str) -> Column:
    """What rows of a component are ordered by: doc_id, null last, then the hash of the text."""
    return F.struct(F.col(id_).isNull().alias("z"), F.col(id_).alias("doc_id"), F.col("th").alias("th"))


def least_rows(rows: DataFrame, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(doc_id, th, least) of rows (doc_id, th, node): least is the least row of their component.

    nodes: (node, best, copies), a row a distinct node with its least row and how many rows have it; roots: connected_components() of them. A node
    or a component with a third of all rows is no hot key: each is looked up.
    """
    stars = roots.withColumnRenamed("node", node)
    rooted = checkpointed(nodes.join(stars, node, "left").select(node, "best", "copies", F.coalesce("root", node).alias("root")))
    least = checkpointed(rooted.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("size")))
    classes = lookup(rooted, least, "root", "size", rooted.count()).select(node, "least", "copies")
    return lookup(rows, checkpointed(classes), node, "copies", rows.count()).select("doc_id", "th", "least")


def only_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stand for their component, all columns as they were. found: least_rows() of docs.

    Rows are told apart by id and text, so an id that stands on several texts takes none of them along; a null id loses to any other. Null and
    empty texts are equal. Repeated rows stay or go together.
    """
    gone = found.filter(~F.col("least").eqNullSafe(order("doc_id"))).select(F.col("doc_id").alias("__gone"), F.col("th").alias("__text"))
    gone = checkpointed(gone.distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["__gone"]) & (F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))) == gone["__text"]), "left_anti")
