"""A sink of pushed lines: `stream.writeStream.format("frames").option("path", ...)`.

Each row is a line of JSON. Tasks write their lines to files of their own; a batch's commit names them in one record, `<batch>.frames`, put in place whole.
A line counts once a record names its file, and the record of a batch is put once: a batch that runs again after a failure adds nothing, and lines of tasks that
died are named by none. A client reads records in order of batches.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

SUFFIX = ".frames"


@dataclass
class Part(WriterCommitMessage):
    name: str
    lines: int


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator) -> Part:
        store, at = self._store()
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        store.create_dir(f"{at}/parts", recursive=True)
        with store.open_output_stream(f"{at}/parts/{name}") as out:
            for row in iterator:
                out.write(f"{row['line']}\n".encode())
                n += 1
        return Part(name, n)

    def commit(self, messages, batchId: int) -> None:
        store, at = self._store()
        final = f"{at}/{batchId:012}{SUFFIX}"
        kept = [m for m in messages if m is not None and m.lines]
        if store.get_file_info(final).type != fs.FileType.NotFound:  # the batch was there already
            return self.abort(messages, batchId)
        half = f"{at}/.{uuid.uuid4().hex}"
        with store.open_output_stream(half) as out:
            out.write(json.dumps([{"part": m.name, "lines": m.lines} for m in kept]).encode())
        store.move(half, final)
        self._drop([m for m in messages if m is not None and not m.lines])

    def abort(self, messages, batchId: int) -> None:
        self._drop([m for m in messages if m is not None])

    def _drop(self, parts) -> None:
        store, at = self._store()
        for m in parts:
            try:
                store.delete_file(f"{at}/parts/{m.name}")
            except FileNotFoundError:
                pass


class FrameSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self):
        return "line string"

    def streamWriter(self, schema, overwrite):
        return FrameWriter(self.options["path"])


def push(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Pushes a stream's rows as lines of JSON."""
    stream.sparkSession.dataSource.register(FrameSink)
    lines = stream.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns])).alias("line"))
    return lines.writeStream.format("frames").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pushed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, line) of all that was pushed."""
    top = path.rstrip("/")
    records = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(top) if _any(spark, top) else None
    if records is None:
        return spark.createDataFrame([], "batch long, line string")
    batch = F.regexp_extract("path", r"([0-9]+)\.frames$", 1).cast("long").alias("batch")
    named = records.select(batch, F.explode(F.from_json(F.col("content").cast("string"), "array<struct<part: string, lines: long>>")).alias("p")).select("batch", "p.part")
    if not _any(spark, f"{top}/parts"):
        return spark.createDataFrame([], "batch long, line string")
    lines = spark.read.text(f"{top}/parts").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"), F.col("value").alias("line"))
    return lines.join(F.broadcast(named), "part").select("batch", "line")  # a row a task of a batch


def _any(spark: SparkSession, path: str) -> bool:
    from pathlake.sources.shared import listing

    return any(name != "parts" for name, _ in listing(spark, path))
