"""Tags: a relation (path, tag), kept as a small JSON document {"version": 1, "tags": {path: [tag, ...]}}."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlake.functions.codecs import clean_tag
from pathlake.sources.shared import stamp

SCHEMA = "path string, tag string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The relation of a tag document; empty where there is none or it is no such document. A store that cannot be reached is an error. Tags are cleaned."""
    if not stamp(spark, path):
        return spark.createDataFrame([], SCHEMA)
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", "version int, tags map<string, array<string>>").alias("j"))
    tags = rows.select(F.explode("j.tags").alias("path", "t")).select("path", F.explode("t").alias("tag"))
    return cleaned(tags)


def save(tags: DataFrame, path: str) -> bool:
    """Writes the document of a relation beside the old one and renames it, unless it says the same; whether it was written."""
    text = to_json(tags)
    try:
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    except FileNotFoundError:
        pass
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
    return True


def cleaned(tags: DataFrame) -> DataFrame:
    return tags.select("path", clean_tag(F.col("tag")).alias("tag")).filter("tag IS NOT NULL").distinct()


def add(tags: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    return cleaned(tags.unionByName(paths.select("path", F.lit(tag).alias("tag"))))


def remove(tags: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    gone = cleaned(paths.select("path", F.lit(tag).alias("tag")))
    return tags.join(gone, ["path", "tag"], "left_anti")


def histogram(tags: DataFrame) -> DataFrame:
    """(tag, n), by tag."""
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def tagged(files: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Files that carry the tag, in any spelling that cleans to it."""
    one = tags.filter(F.col("tag") == clean_tag(F.lit(tag))).select("path")
    return files.join(one, "path", "left_semi")


def with_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """files with `tags`, a sorted array, empty where there are none."""
    by = tags.groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return files.join(by, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def prune_missing(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Tags of paths that are still there."""
    return tags.join(files.select("path"), "path", "left_semi")


def to_json(tags: DataFrame) -> str:
    """The document of a relation. Tags are set by hand, so the relation is small; it is the one thing here that is collected."""
    rows = tags.groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("t")).orderBy("path").collect()
    return json.dumps({"version": 1, "tags": {r["path"]: list(r["t"]) for r in rows}}, ensure_ascii=False, indent=1)
