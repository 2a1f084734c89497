"""Texts stored with a trigram filter for each of their files, so that a content search reads only files that may hold its pattern.

    <dir>/<name>/texts/     (path, text), by path, FILE_ROWS rows to a Parquet file
    <dir>/<name>/filters/   (file, bits): which trigrams, hashed to BITS bits, stand in any text of a file

A pattern's required letters give trigrams that must all be there. The filter never leaves out a file with a match; the pattern itself is still tested on every text that is read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlake.plans.compiler import Compiled
from pathlake.sources.shared import delete, listing, put_if_absent, read_text

#: Bits of a file's filter, and rows of a file.
BITS, FILE_ROWS = 1 << 16, 512
#: Fixed by Unicode: letters that a match without case takes for an ASCII letter.
FOLDS = str.maketrans({"K": "k", "ſ": "s", "İ": "i", "ı": "i"})


def slots(text: str) -> np.ndarray:
    """The slots of a text's trigrams of UTF-8 bytes, without case."""
    b = np.frombuffer(text.translate(FOLDS).lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return np.unique((h ^ (h >> np.uint32(15))) % np.uint32(BITS))


def required(pattern: str) -> list[str]:
    """Runs of ASCII characters that stand in whatever the regular expression matches; none where that takes more than reading it from left to right."""
    if any(c in pattern for c in "|()"):
        return []
    runs, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            if i == len(pattern):
                return []
            if pattern[i].isalnum() or not pattern[i].isascii():  # a class, an anchor or a code
                if pattern[i] not in "bBdDsSwW":
                    return []
                end()
            else:
                run += pattern[i]
        elif c == "[":
            end()
            close = pattern.find("]", i + 3 if pattern.startswith("[^", i) else i + 2)
            if close < 0 or "[" in pattern[i + 1 : close] or "\\" in pattern[i:close] or "&&" in pattern[i:close]:
                return []
            i = close
        elif c in "*?{":  # what is before may be missing
            run = run[:-1]
            end()
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return []
        elif c in "+.^$" or not c.isascii():
            end()
        else:
            run += c
        i += 1
    end()
    return [r for r in runs if len(r) >= 3]


class TextIndex:
    """Texts with their filters in a folder. key says what they were made of: another key makes them anew."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir = spark, directory.rstrip("/")

    def _name(self, key: str) -> str | None:
        at = f"{self.dir}/{key}.ready"
        return read_text(self.spark, at) if f"{key}.ready" in {n for n, _ in listing(self.spark, self.dir)} else None

    def build(self, doc_text: DataFrame, key: str) -> TextIndex:
        """Stores doc_text (path, text), each path once, unless it is there. Null texts are left out."""
        self.key = key
        if self._name(key) is None:
            name = uuid.uuid4().hex
            rows = doc_text.select("path", "text").filter("text IS NOT NULL")
            rows.repartitionByRange("path").sortWithinPartitions("path").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.dir}/{name}/texts")
            self._filters(name).write.parquet(f"{self.dir}/{name}/filters")
            if not put_if_absent(self.spark, f"{self.dir}/{key}.ready", name):
                delete(self.spark, f"{self.dir}/{name}")  # someone else was first
            for old, _ in listing(self.spark, self.dir):
                if old not in (f"{key}.ready", self._name(key)):
                    delete(self.spark, f"{self.dir}/{old}")
        return self

    def _filters(self, name: str) -> DataFrame:
        """(file, bits): a task fills the filters of the files that it reads; parts of one file are put together."""

        def fill(batches):
            found: dict[str, np.ndarray] = {}
            for rows in batches:
                for file, text in zip(rows["file"], rows["text"]):
                    found.setdefault(file, np.zeros(BITS, bool))[slots(text)] = True
            packed = [np.packbits(bits, bitorder="little").view("<i8").tolist() for bits in found.values()]
            if found:
                yield pd.DataFrame({"file": list(found), "bits": packed})

        texts = self.spark.read.schema("path string, text string").parquet(f"{self.dir}/{name}/texts")
        parts = texts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "text").mapInPandas(fill, "file string, bits array<bigint>")
        both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
        lists = parts.groupBy("file").agg(F.collect_list("bits").alias("all"))
        return lists.select("file", F.aggregate(F.slice("all", 2, BITS), F.get("all", F.lit(0)), both).alias("bits"))

    def files(self, pattern: str) -> list[str] | None:
        """The files that may hold a match, None for all of them."""
        runs = required(pattern)
        if not runs:
            return None
        wanted = sorted({int(s) for r in runs for s in slots(r)})
        has = F.lit(True)
        for s in wanted:
            has &= F.shiftrightunsigned(F.get("bits", F.lit(s // 64)), s % 64).bitwiseAND(F.lit(1)) == 1
        rows = self.spark.read.schema("file string, bits array<bigint>").parquet(f"{self.dir}/{self._name(self.key)}/filters")
        return [r["file"] for r in rows.filter(has).select("file").orderBy("file").collect()]  # names of files

    def texts(self, query: Compiled) -> DataFrame:
        """(path, text) of the files that a query's content pattern may be in."""
        at, schema = f"{self.dir}/{self._name(self.key)}/texts", "path string, text string"
        files = self.files(query.query.content) if query.query.content is not None else None
        if files == []:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*([at] if files is None else [f"{at}/{f}" for f in files]))
