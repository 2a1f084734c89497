"""Events to changes, merged micro-batch by micro-batch; and `watch`, which reports each new match once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathlake.functions.paths import clean_prefix, derive
from pathlake.operators.search import search
from pathlake.plans.compiler import compile_query
from pathlake.plans.query import Query
from pathlake.schema import DELTA
from pathlake.sources.catalog import Catalog
from pathlake.sources.shared import checkpointed
from pathlake.sources.walk import WalkOptions, below

UPSERTS, REMOVALS = ("create", "rename_to", "data", "metadata"), ("remove", "rename_from")


def normalise(events: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Changes of events (path, kind, size, mtime, is_dir, seq): works on tables and streams. Other kinds, null paths and paths outside the roots are left out."""
    op = F.when(F.col("kind").isin(*UPSERTS), "upsert").when(F.col("kind").isin(*REMOVALS), "remove")
    rows = events.select("path", op.alias("op"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "seq")
    rows = rows.filter("op IS NOT NULL AND path IS NOT NULL AND seq IS NOT NULL")
    if roots is not None:
        keep = F.lit(False)
        for r in roots:
            p = clean_prefix(r)
            keep |= (F.col("path") == p) | F.col("path").startswith("/" if p == "/" else p + "/")
        rows = rows.filter(keep)
    return rows.select(*DELTA.names)


def ingest(events: DataFrame, catalog: Catalog, checkpoint: str, roots: list[str] | None = None, compact_at: int | None = None, walk_created: WalkOptions | None = None, after: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """Appends the changes of a stream of events to a catalog; with compact_at, compacts it after a batch that brings it over.

    walk_created: directories that appear are walked, as what lies in them may be older than any watch. after is called with a batch's number
    once its changes can be searched, as by results that are shown live.
    A batch that is replayed after a failure appends its changes again, which changes nothing: they have the same seq.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = checkpointed(batch)
        if walk_created is not None:
            batch = batch.unionByName(below(batch, walk_created))
        catalog.apply(batch)
        if compact_at is not None:
            catalog.compact(compact_at)
        if after is not None:
            after(number)

    return normalise(events, roots).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_results(events: DataFrame, catalog: Catalog, query: Query, show: Callable[[DataFrame], None], checkpoint: str, now: int | None = None, debounce_ms: int = 700, **trigger) -> StreamingQuery:
    """ingest() that shows a query's results anew after every batch of changes; a batch waits debounce_ms for more of them."""
    return ingest(events, catalog, checkpoint, after=lambda _: show(search(catalog.files(), query, now=now)), **(trigger or {"processingTime": f"{debounce_ms} milliseconds"}))


def extract_stream(changes: DataFrame, catalog: Catalog, read_text, checkpoint: str, **trigger) -> StreamingQuery:
    """A second stream that extracts texts of changed files: read_text maps a DataFrame of paths to (path, text).

    A text has the seq of the change that it was read for, so what a later change says wins, whichever stream wrote it. What is removed loses its text.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch = checkpointed(batch)
        wanted = batch.filter("op = 'upsert' AND NOT is_dir").groupBy("path").agg(F.max("seq").alias("seq"))
        found = wanted.join(read_text(wanted.select("path")), "path")
        catalog.add_texts(found)
        gone = batch.filter("op = 'remove'").groupBy("path").agg(F.max("seq").alias("seq"))
        catalog.add_texts(gone.select("path", F.lit(None).cast("string").alias("text"), "seq"))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(events: DataFrame, query: Query, now: int) -> DataFrame:
    """A stream of matching entries (path, size, mtime, is_dir), each path once. What is removed is not reported.

    Paths that were reported are kept as state, as the contract of `watch` wants; it grows with the number of matches, not of events.
    """
    compiled = compile_query(query, now)
    rows = derive(normalise(events).filter("op = 'upsert'").select("path", "size", "mtime", "is_dir"))
    return rows.filter(compiled.predicate()).select("path", "size", "mtime", "is_dir").dropDuplicates(["path"])


def replay(events: DataFrame, base: DataFrame, base_seq: int = -1) -> DataFrame:
    """The batch twin of ingest: what the catalog holds after all events."""
    from pathlake.operators.overlay import merge

    return merge(base, normalise(events), base_seq).drop("seq")
