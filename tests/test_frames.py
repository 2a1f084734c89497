"""Pushed lines and polls: each line once, whatever runs again."""

import json
import os
import shutil

from pathlake.engine import Engine
from pathlake.plans.query import Query
from pathlake.schema import DELTA, ENTRY
from pathlake.streaming import frames


def lines(spark, at):
    return sorted(json.loads(r["line"])["a.b"] for r in frames.pushed(spark, at).collect())


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    src, at, cp = tmp_path / "src", str(tmp_path / "out"), tmp_path / "cp"
    schema = "`a.b` long, text string"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).repartition(3).write.mode("append").json(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(str(src))
        frames.push(stream, at, str(cp)).awaitTermination()

    assert frames.pushed(spark, at).count() == 0
    run([(i, "x\ny") for i in range(7)])
    assert lines(spark, at) == list(range(7))
    run([(i, None) for i in range(7, 12)])
    assert lines(spark, at) == list(range(12))
    # the last batch was pushed, but its end is not known: it runs again
    last = max((n for n in os.listdir(cp / "commits") if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if (cp / "commits" / name).exists():
            (cp / "commits" / name).unlink()
    parts = len(os.listdir(f"{at}/parts"))
    run([])
    assert lines(spark, at) == list(range(12)) and len([n for n in os.listdir(f"{at}/parts") if not n.startswith(".")]) <= parts
    assert sorted({r["batch"] for r in frames.pushed(spark, at).collect()}) == sorted(int(n.split(".")[0]) for n in os.listdir(at) if n.endswith(".frames") and json.load(open(f"{at}/{n}")))


def test_lines_of_a_task_that_died_are_not_read(spark, tmp_path):
    at = str(tmp_path / "out")
    w = frames.FrameWriter(at)
    good, lost = w.write(iter([{"line": '{"a.b": 1}'}])), w.write(iter([{"line": '{"a.b": 2}'}]))
    w.commit([good, None], 0)
    assert lines(spark, at) == [1] and lost.lines == 1
    w.commit([w.write(iter([{"line": '{"a.b": 3}'}]))], 0)
    assert lines(spark, at) == [1]
    w.commit([w.write(iter([]))], 1)
    assert lines(spark, at) == [1]


def test_polls(spark, tmp_path):
    """Each path once, the limit that of one search, over restarts; a poll that is made again gives the same."""
    e = Engine(spark, str(tmp_path / "cat"))
    e.catalog.rebuild(spark.createDataFrame([(f"/d/{i:02}", i, 1, False) for i in range(10)], ENTRY))
    seen, q = str(tmp_path / "seen"), Query(limit=4)
    names = lambda rows: sorted(r["path"][-2:] for r in rows)
    assert [names(rows) for rows in e.watch(q, 1, 2, lambda _: None, seen)] == [["00", "01", "02", "03"], []]
    e.catalog.apply(spark.createDataFrame([(f"/d/{i:02}", "remove", None, None, None, 1) for i in (1, 2)], DELTA))
    again = Engine(spark, str(tmp_path / "cat"))
    assert [names(rows) for rows in again.watch(q, 1, 1, seen=seen)] == [["04", "05"]]
    assert names(again.poll(q, 2, seen).collect()) == ["04", "05"] and names(Engine(spark, str(tmp_path / "cat")).reported(seen).collect()) == ["00", "01", "02", "03", "04", "05"]
    shutil.rmtree(seen)
    assert [names(rows) for rows in again.watch(q, 1, 1, seen=seen)] == [["00", "03", "04", "05"]]
