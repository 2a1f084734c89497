"""The change overlay: a base snapshot merged with upserts and subtree removals.

Changes are ordered by `seq`. A row is visible if it is the latest of its path and no later removal stands for its path
or for a directory above it. So a directory that is removed and made again does not bring its old children back.
Prefix conditions are joins on equality with the array of ancestors, never LIKE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlake.functions.paths import ancestors_of
from pathlake.operators.search import SMALL, small_side
from pathlake.sources.shared import checkpointed

META = ("path", "size", "mtime", "is_dir")
#: So many tombstones or excluded paths are written into the plan as literals.
INLINE = 64


def latest(delta: DataFrame) -> DataFrame:
    """The last change of each path. Aggregated in each task before the shuffle, so a path with many changes is no hot key."""
    rest = [c for c in delta.columns if c not in ("path", "seq")]
    last = delta.groupBy("path").agg(F.max_by(F.struct("seq", *rest), F.struct("seq", (F.col("op") == "upsert"))).alias("r"))
    return last.select("path", "r.*").select(*delta.columns)


def tombstones(delta: DataFrame) -> DataFrame:
    """(root, gone_at): when each removed subtree was last removed."""
    return delta.filter("op = 'remove'").groupBy(F.col("path").alias("root")).agg(F.max("seq").alias("gone_at"))


def alive(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (path, seq, ...) that no tombstone (root, gone_at) of theirs is newer than.

    A few tombstones (INLINE) are written into the plan and rows are filtered where they lie. More of them are joined with the ancestors, by
    broadcast up to SMALL, and only what they hit is taken out of the rows.
    """
    head = checkpointed(gone.limit(SMALL + 1))
    n = head.count()
    if n <= INLINE:
        dead = F.lit(False)
        for r in head.collect():
            root = "/" if r["root"] == "/" else r["root"] + "/"
            dead |= ((F.col("path") == r["root"]) | F.col("path").startswith(root)) & (F.col("seq") <= r["gone_at"])
        return rows.filter(~dead)
    at = rows.select("path", "seq", F.explode(ancestors_of(F.col("path"))).alias("root"))
    dead = at.join(F.broadcast(head) if n <= SMALL else gone, "root").filter("gone_at >= seq").select("path", "seq")
    return rows.join(small_side(dead), ["path", "seq"], "left_anti")


def merge(base: DataFrame, delta: DataFrame, base_seq: int = -1) -> DataFrame:
    """(path, size, mtime, is_dir, seq): what is there after the delta. Rows of the base have seq base_seq; changes up to it are already in the base."""
    new = delta.filter(F.col("seq") > base_seq)
    gone = tombstones(new)
    upserts = latest(new).filter("op = 'upsert'").select(*META, "seq")
    if "seq" not in base.columns:
        base = base.withColumn("seq", F.lit(base_seq).cast("long"))
    kept = base.select(*META, "seq").join(upserts.select("path"), "path", "left_anti")
    return alive(kept.unionByName(upserts), gone)


def prune(delta: DataFrame, base: DataFrame) -> DataFrame:
    """After a rebuild: upserts of paths that the new base lacks, and removals of paths that it has (their subtrees too)."""
    last = latest(delta)
    added = last.filter("op = 'upsert'").join(base.select("path"), "path", "left_anti")
    # the removals are the small side: only ancestors that one of them names are shuffled
    gone = last.filter("op = 'remove'")
    there = base.select(F.explode(ancestors_of(F.col("path"))).alias("path")).join(small_side(gone.select("path")), "path", "left_semi").distinct()
    removed = gone.join(there, "path", "left_semi")
    return added.unionByName(removed)


def dirty(delta: DataFrame) -> DataFrame:
    """One row, `n`: paths with a pending change."""
    return delta.agg(F.count_distinct("path").alias("n"))


def counts_with(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row, `files` and `dirs`: the base's counts, more by what was added and less by what was removed, without merging. A removal counts for its own path alone."""
    count = lambda rows, sign: rows.agg((F.count_if(~F.col("is_dir")) * sign).alias("files"), (F.count_if("is_dir") * sign).alias("dirs"))
    last = latest(delta)
    here = base.select("path", F.col("is_dir").alias("was_dir"))
    added = last.filter("op = 'upsert'").join(here, "path", "left_anti")
    removed = here.join(small_side(last.filter("op = 'remove'").select("path")), "path", "left_semi").select(F.col("was_dir").alias("is_dir"))
    parts = count(base, 1).unionByName(count(added, 1)).unionByName(count(removed, -1))
    return parts.agg(F.sum("files").alias("files"), F.sum("dirs").alias("dirs"))


def assign_ids(entries: DataFrame, by: tuple[str, ...] = ("path",), first: int = 1) -> DataFrame:
    """entries with `id`, from `first` on, in the order of columns `by`: the same for the same entries. Ranges are numbered side by side; no task sees them all.

    The ordered rows are written once, with the place of each in its range: the bounds of ranges are drawn from a sample, and would not be
    the same in a second run. Counting ranges and numbering rows both read what was written.
    """
    row = (1 << 33) - 1  # monotonically_increasing_id: the partition's number above 33 bits, the row's place below
    ordered = entries.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ordered = checkpointed(ordered)
    part = F.shiftright("__at", 33).alias("__part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a number a partition
    offsets, start = [], first
    for r in sizes:
        offsets.append((r["__part"], start))
        start += r["n"]
    table = entries.sparkSession.createDataFrame(offsets, "__part long, __start long")
    rows = ordered.withColumn("__part", part).join(F.broadcast(table), "__part")
    return rows.withColumn("id", F.col("__start") + F.col("__at").bitwiseAND(F.lit(row))).drop("__part", "__start", "__at")
