"""Sinks: result lists as CSV, TSV or JSON, result rows and envelopes as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlake.functions.paths import name_of
from pathlake.operators.search import SearchResult


def export(rows: DataFrame, path: str, kind: str) -> None:
    """name, path, size, modified (epoch seconds) of a result; JSON has is_dir too."""
    out = rows.select(name_of(F.col("path")).alias("name"), "path", "size", F.col("mtime").alias("modified"), "is_dir")
    if kind == "json":
        out.write.mode("overwrite").json(path)
    else:
        out.drop("is_dir").write.mode("overwrite").csv(path, sep={"csv": ",", "tsv": "\t"}[kind], header=True)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON object a row, as text."""
    return rows.select(F.to_json(F.struct("path", "size", "mtime", "is_dir")).alias("value"))


def envelope(result: SearchResult) -> str:
    """The answer of a search as one JSON object; as many rows as its limit, which bounds it."""
    rows = [json.loads(r["value"]) for r in json_rows(result.results).collect()]
    return json.dumps({"results": rows, "truncated": result.truncated, "elapsed_ms": result.elapsed_ms, "indexed": result.indexed}, ensure_ascii=False)
