"""The folder that driver and executors share, and what is kept there for a while."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of our own. On a cluster that would be of no use to executors, so it is an error there."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="pathlake-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffle files when they end; else these stay until the driver happens to collect its garbage.

    For work whose steps are checkpointed(): a query that is run a second time would have to shuffle again. On many partitions a shuffle takes
    disk for each, however few the rows, so a long row of steps holds more in files of what is done than in data.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of the shared store, if it is there."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder of the shared store; none if it isn't there."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def stamp(spark: SparkSession, path: str) -> str:
    """Changes with the files in a folder (or with one file): a hash of their names, sizes and times. "" if there is nothing."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return ""
    found = sorted(f"{x.getPath().getName()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(at))
    return hashlib.sha256("\n".join([path, *found]).encode()).hexdigest() if found else ""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole, unless it is there; whether it did. Of several writers one succeeds.

    The text goes to a file of its own, which is then renamed without replacing; in a local file system it is linked, as renaming replaces there.
    """
    jvm = spark.sparkContext._jvm
    final, fs = _at(spark, path)
    part, _ = _at(spark, f"{final.getParent()}/.{final.getName()}.{uuid.uuid4().hex}")
    if fs.exists(final):
        return False
    fs.mkdirs(final.getParent())
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(part.toUri().getPath(), final.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, final, none)
        return True
    except (FileExistsError, Py4JJavaError):
        if not fs.exists(final):  # another error than a lost race
            raise
        return False
    finally:
        fs.delete(part, False)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the shared store."""
    at, fs = _at(spark, path)
    source = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in milliseconds) of what lies in a folder, but for hidden files; nothing if it isn't there."""
    at, fs = _at(spark, path)
    return sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(at) if not x.getPath().getName().startswith(".")) if fs.exists(at) else []
