"""Archive members: listings and contents of zip and tar files, as table functions over their bytes."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.schema import ARCHIVE_LIST_MAX, ARCHIVE_MAX, ARCHIVE_NAMES, MEMBER_MAX, PROBE, TAR_MEMBERS_MAX, ZIP_ARCHIVES


def is_archive(name_ext: Column) -> Column:
    return name_ext.isin(ARCHIVE_NAMES)


def is_readable(name_ext: Column) -> Column:
    return name_ext.isin([*ZIP_ARCHIVES, "tar"])


def members(data: bytes, ext: str):
    """(name, size, is_dir, read) of an archive's members in order; nothing for one that cannot be read."""
    try:
        if ext in ZIP_ARCHIVES:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    yield i.filename, i.file_size, i.is_dir(), lambda i=i: z.read(i)
        elif ext == "tar":
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                for n, i in enumerate(t):
                    if n >= TAR_MEMBERS_MAX:
                        return
                    if i.isfile() or i.isdir():
                        yield i.name, i.size, i.isdir(), lambda i=i: t.extractfile(i).read()
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, NotImplementedError):
        return


def listing(data: bytes, ext: str, most: int = ARCHIVE_LIST_MAX) -> list[tuple[str, int, bool]]:
    out = []
    for name, size, is_dir, _ in members(data, ext):
        if len(out) >= most:
            break
        out.append((name, size, is_dir))
    return out


def contents(data: bytes, ext: str, most: int = ARCHIVE_MAX, member: int = MEMBER_MAX):
    """(name, bytes) of files of up to `member` bytes, until `most` bytes are read."""
    total = 0
    for name, size, is_dir, read in members(data, ext):
        if is_dir or size > member:
            continue
        if total >= most:
            return
        try:
            body = read()
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, NotImplementedError):
            continue
        total += len(body)
        yield name, body


@F.udtf(returnType=T.StructType([T.StructField("member", T.StringType()), T.StructField("size", T.LongType()), T.StructField("is_dir", T.BooleanType())]))
class ArchiveList:
    def eval(self, content: bytes, ext: str):
        yield from listing(bytes(content), ext) if content is not None else ()


@F.udtf(returnType=T.StructType([T.StructField("member", T.StringType()), T.StructField("body", T.BinaryType())]))
class ArchiveRead:
    def eval(self, content: bytes, ext: str):
        yield from contents(bytes(content), ext) if content is not None else ()


def register(spark: SparkSession) -> None:
    spark.udtf.register("archive_list", ArchiveList)
    spark.udtf.register("archive_read", ArchiveRead)


def list_members(archives: DataFrame) -> DataFrame:
    """(path, member, size, is_dir) of archives (path, name_ext, content)."""
    spark = archives.sparkSession
    register(spark)
    readable = archives.filter(is_readable(F.col("name_ext")))
    return spark.sql("SELECT a.path, m.member, m.size, m.is_dir FROM {readable} a, LATERAL archive_list(a.content, a.name_ext) m", readable=readable)


def member_texts(archives: DataFrame) -> DataFrame:
    """(path, member, text) of readable members that are UTF-8 without a zero byte near their beginning; others are left out, as binary files are."""
    spark = archives.sparkSession
    register(spark)
    readable = archives.filter(is_readable(F.col("name_ext")))
    rows = spark.sql("SELECT a.path, m.member, m.body FROM {readable} a, LATERAL archive_read(a.content, a.name_ext) m", readable=readable)
    text = F.col("body").cast("string")
    binary = F.position(F.lit(b"\0"), F.substring("body", 1, PROBE)) > 0
    return rows.filter(F.is_valid_utf8(text) & ~binary).select("path", "member", text.alias("text"))
