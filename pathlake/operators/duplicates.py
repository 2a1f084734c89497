"""Duplicate files: size, then a prefix, then the whole content; and search by content hash.

Each step keeps only members of groups of two or more before the next, dearer one, and what it keeps is written, so that contents are read once a step
and only of what is left. Groups are counted by partial aggregation and rows semi-joined to the groups that are left, so no group is gathered in one task.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlake.operators.search import small_side
from pathlake.sources.shared import checkpointed

#: Bytes of a prefix, and of a read.
PREFIX, READ = 64 << 10, 1 << 20
DIGESTED = "path string, size long, mtime long, digest string, read long"


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys another row has too. Written once: what follows reads them twice."""
    rows = checkpointed(rows)
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return checkpointed(rows.join(many, list(keys), "left_semi"))


def duplicate_members(files: DataFrame, content: str | Column | DataFrame = "content", inode: str | None = None) -> DataFrame:
    """(path, size, mtime, digest) of every file whose content another has; empty files aside. With inode, hard links count once.

    content: a column of files, or a table (path, text) of its own, which is read for candidates alone.
    """
    rows = files.filter(~F.col("is_dir") & (F.col("size") > 0))
    if inode:
        first = rows.groupBy(inode).agg(F.min("path").alias("path"))
        rows = rows.join(first.select("path"), "path", "left_semi")
    if isinstance(content, DataFrame):
        bodies = content.select("path", F.col("text").alias("__body"))
    else:
        bodies = rows.select("path", (F.col(content) if isinstance(content, str) else content).alias("__body"))

    def read(wanted: DataFrame, body: Column, name: str) -> DataFrame:
        return bodies.join(small_side(wanted), "path").select(*wanted.columns, F.sha2(body.cast("binary"), 256).alias(name))

    slim = _shared(rows.select("path", "size", "mtime"), "size")
    heads = _shared(read(slim, F.substring("__body", 1, PREFIX), "head"), "size", "head")
    return _shared(read(heads.drop("head"), F.col("__body"), "digest"), "size", "digest").select("path", "size", "mtime", "digest")


def _digested(wanted: DataFrame, most: int | None) -> DataFrame:
    """wanted (path, size, mtime) with the digest of the file's first `most` bytes (None: all) and how many were read. Read where the row lies, READ bytes at a time;
    files that can't be read, or have another size by now, are left out. Executors must see the files."""

    def run(batches):
        for rows in batches:
            out = []
            for path, size, mtime in zip(rows["path"], rows["size"], rows["mtime"]):
                digest, left, done = hashlib.sha256(), size if most is None else min(size, most), 0
                try:
                    with open(path, "rb") as f:
                        if os.fstat(f.fileno()).st_size != size:
                            continue
                        while done < left and (part := f.read(min(READ, left - done))):
                            digest.update(part)
                            done += len(part)
                except OSError:
                    continue
                if done == left:
                    out.append((path, size, mtime, digest.hexdigest(), done))
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "digest", "read"])

    return wanted.select("path", "size", "mtime").mapInPandas(run, DIGESTED)


def _linked_once(wanted: DataFrame) -> DataFrame:
    """Of paths that are one file (hard links) the first; what isn't a plain file is left out."""

    def run(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                try:
                    st = os.lstat(row.path)
                except OSError:
                    continue
                if os.path.isfile(row.path) and not os.path.islink(row.path):
                    out.append((*row, f"{st.st_dev}:{st.st_ino}"))
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "inode"])

    known = checkpointed(wanted.select("path", "size", "mtime").mapInPandas(run, "path string, size long, mtime long, inode string"))
    first = known.groupBy("inode").agg(F.min("path").alias("path"))
    return known.join(first, ["inode", "path"], "left_semi").drop("inode")


def duplicate_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, reads): duplicate_members() of files as they lie in the file system, hard links counted once, and (path, step, read): which bytes that took.

    Only files that share their size with another are touched; of these the first PREFIX bytes are read, and the whole of those that agree in them. A file no longer than
    a prefix is read once.
    """
    rows = files.filter(~F.col("is_dir") & (F.col("size") > 0)).select("path", "size", "mtime")
    slim = _shared(_linked_once(_shared(rows, "size")), "size")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    heads = checkpointed(_digested(slim.repartition(cores, "path"), PREFIX))
    same = _shared(heads, "size", "digest")
    short = same.filter(F.col("size") <= PREFIX)
    whole = checkpointed(_digested(same.filter(F.col("size") > PREFIX).repartition(cores, "path"), None))
    members = short.unionByName(_shared(whole, "size", "digest")).select("path", "size", "mtime", "digest")
    reads = heads.select("path", F.lit("prefix").alias("step"), "read").unionByName(whole.select("path", F.lit("whole").alias("step"), "read"))
    return members, reads


def duplicate_groups(members: DataFrame, most: int | None = None) -> DataFrame:
    """(digest, size, n, waste, keep): a row a group, the most wasteful first. keep is the newest member, then the first path."""
    keep = F.max_by("path", F.struct("mtime", F.col("path"))).alias("keep")
    g = members.groupBy("digest", "size").agg(F.count("*").alias("n"), keep).withColumn("waste", (F.col("n") - 1) * F.col("size"))
    g = g.orderBy(F.desc("waste"), "digest")
    return g.limit(most) if most else g


def find_by_hash(files: DataFrame, digest: str, content: str = "content", largest: int = 512 << 20) -> DataFrame:
    """Files with this SHA-256; directories and files over `largest` are not read."""
    return files.filter(~F.col("is_dir") & (F.col("size") <= largest)).filter(F.sha2(F.col(content).cast("binary"), 256) == digest.strip().lower())
