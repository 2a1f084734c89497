"""The trash: listing of info records and plans for moves. Nothing here touches files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlake.functions.codecs import decode_path_column, encode_path_column
from pathlake.functions.paths import dir_of, name_of
from pathlake.operators.search import small_side

INFO = "[Trash Info]"


def parse_info(records: DataFrame) -> DataFrame:
    """(name, original_path, deletion_date) of records (file, value): whole .trashinfo files. Records without a path are left out."""
    name = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^(.*)\.trashinfo$", 1)
    raw = F.regexp_extract("value", r"(?m)^Path=(.*)$", 1)
    date = F.regexp_extract("value", r"(?m)^DeletionDate=(.*)$", 1)
    rows = records.select(name.alias("name"), raw.alias("raw"), F.trim(date).alias("deletion_date")).filter("name != '' AND raw != ''")
    return rows.select("name", decode_path_column(F.col("raw")).alias("original_path"), "deletion_date")


def listing(info: DataFrame, payload: DataFrame) -> DataFrame:
    """Trashed items whose payload (name) is there, newest first, then by name from the end."""
    return info.join(payload.select("name"), "name", "left_semi").orderBy(F.desc("deletion_date"), F.desc("name"))


def _split_number(name: Column, of_stem: bool) -> tuple[Column, Column, Column]:
    """(stem, number, extension) of a name: "x.tar.2" is number 2 of "x.tar", or with of_stem "x.2.tar" number 2 of "x.tar"; without a number 1.

    A name that reads like a numbered one is taken for it, so that no number is given twice.
    """
    if of_stem:
        ext = F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)
        ext = F.when(ext.rlike(r"^\.([2-9]|[1-9]\d{1,8})$"), "").otherwise(ext)
        bare = F.left(name, F.char_length(name) - F.char_length(ext))
    else:
        ext, bare = F.lit(""), name
    found = F.regexp_extract(bare, r"^.+\.([2-9]|[1-9]\d{1,8})$", 1)  # not regexp_extract's null: no match is ""
    stem = F.when(found == "", bare).otherwise(F.left(bare, F.char_length(bare) - F.char_length(found) - 1))
    return stem, F.when(found == "", 1).otherwise(found.cast("long")).cast("long"), ext


def _free_names(wanted: DataFrame, taken: DataFrame, keys: list[str], of_stem: bool) -> DataFrame:
    """wanted (its columns, keys and `name` among them) with `free`: its name if none has it, else one with the next number, no two alike.

    taken: keys and `name`. Of several that want a name the first in the order of `path` gets it. Numbers go on from the greatest of those in
    use and those that are wanted as they are, so what is given is never in use. Names are matched by equality on their stems.
    """
    stem, number, ext = _split_number(F.col("name"), of_stem)
    group = [*keys, "__stem", "__ext"]
    want = wanted.withColumn("__stem", stem).withColumn("__n", number).withColumn("__ext", ext)
    stems = want.select(*group).distinct()
    used = taken.select(*keys, "name").distinct().withColumn("__stem", stem).withColumn("__n", number).withColumn("__ext", ext)
    used = used.join(small_side(stems), group, "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("path")) == 1
    held = used.select(*keys, "name", F.lit(True).alias("__held"))
    want = want.withColumn("__first", first).join(held, [*keys, "name"], "left")
    want = want.withColumn("__own", F.col("__first") & F.col("__held").isNull())
    top = used.select(*group, "__n").unionByName(want.filter("__own").select(*group, "__n")).groupBy(*group).agg(F.max("__n").alias("__top"))
    place = F.row_number().over(Window.partitionBy(*group, "__own").orderBy("path"))
    rows = want.withColumn("__place", place).join(top, group, "left")
    given = F.concat("__stem", F.lit("."), (F.greatest(F.coalesce("__top", F.lit(1)), F.lit(1)) + F.col("__place")).cast("string"), "__ext")
    return rows.withColumn("free", F.when(F.col("__own"), F.col("name")).otherwise(given)).select(*wanted.columns, "free")


def trash_plan(paths: DataFrame, taken: DataFrame, when: str) -> DataFrame:
    """(path, name, info): under which free name each path would go to the trash, and its info record. taken: names in use.

    A name that is taken gets the next number behind it ("a.txt.2"). No two plans have the same name, nor one that is in use.
    """
    wanted = paths.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = _free_names(wanted, taken.select("name"), [], False)
    info = F.concat(F.lit(f"{INFO}\nPath="), encode_path_column(F.col("path")), F.lit(f"\nDeletionDate={when}\n"))
    return rows.select("path", F.col("free").alias("name"), info.alias("info"))


def restore_plan(items: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, target, conflict, free): where each item would go back to, whether something is there already, and a free path: the target, or one with a number before its extension.

    Names that aren't those of a single entry (empty, ".", "..", or with a slash) are refused: such items have no plan.
    """
    items = items.filter(F.col("name").isNotNull() & ~F.col("name").isin("", ".", "..") & ~F.col("name").contains("/"))
    path = F.col("path")
    there = existing.select(dir_of(path).alias("dir"), name_of(path).alias("name"))
    wanted = items.select(F.col("name").alias("item"), F.col("original_path").alias("path"))
    wanted = wanted.select("item", "path", dir_of(path).alias("dir"), name_of(path).alias("name"))
    rows = _free_names(wanted, there, ["dir"], True)
    held = existing.select("path", F.lit(True).alias("there")).distinct()
    rows = rows.join(held, "path", "left")
    free = F.concat(F.when(F.col("dir") == "/", "").otherwise(F.col("dir")), F.lit("/"), F.col("free"))
    return rows.select(F.col("item").alias("name"), F.col("path").alias("target"), F.coalesce("there", F.lit(False)).alias("conflict"), free.alias("free"))


def rename_preview(files: DataFrame, existing: DataFrame, find: str, replace: str, regex: bool = False, counter: bool = False) -> DataFrame:
    """(path, new_path, conflict): what a bulk rename would do. "{n}" in replace is a running number by path, if counter.

    conflict: the target is there already and isn't renamed away, or two sources have it.
    """
    new = F.regexp_replace("name", find, replace) if regex else F.replace("name", F.lit(find), F.lit(replace))
    rows = files.select("path", "dir", "name", new.alias("new"))
    if counter:
        n = F.row_number().over(Window.partitionBy("dir").orderBy("path"))
        rows = rows.withColumn("new", F.replace("new", F.lit("{n}"), n.cast("string")))
    rows = rows.withColumn("new_path", F.concat(F.when(F.col("dir") == "/", "").otherwise(F.col("dir")), F.lit("/"), "new")).filter("new != name")
    stay = existing.select("path").join(rows.select("path"), "path", "left_anti").select(F.col("path").alias("new_path"), F.lit(True).alias("there"))
    shared = F.count("*").over(Window.partitionBy("new_path")) > 1
    return rows.join(stay, "new_path", "left").select("path", "new_path", (F.coalesce("there", F.lit(False)) | shared | (F.col("new") == "")).alias("conflict"))
