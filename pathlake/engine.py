"""The engine: a catalog with its settings, and a line-oriented JSON protocol over it."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlake.config import Config
from pathlake.operators import search
from pathlake.operators.exclusions import mounts_excluded
from pathlake.plans.patterns import PatternError
from pathlake.plans.query import Query, QueryError
from pathlake.schema import CANDIDATE_CAP, CONTENT_MIN
from pathlake.sources import documents, export, walk
from pathlake.sources.catalog import Catalog
from pathlake.sources.mounts import read_mounts
from pathlake.sources.shared import checkpointed, delete, listing, shared_dir

REPORTED = "path string, size long, mtime long, is_dir boolean"


class Engine:
    """Walks, searches and keeps a catalog. Changes apply to the next query; a paused engine takes none.

    mounts: a mount table, to leave out what the settings exclude; None: none is looked at.
    """

    WALK_KEYS = {"roots", "exclude_dirs", "exclude_names_file", "respect_ignore_files", "follow_symlinks", "index_hidden_dirs", "extra_excluded_fstypes", "exclude_network", "exclude_removable"}
    #: Seconds between two rescans, whatever the settings say.
    RESCAN_LEAST = 5

    def __init__(self, spark: SparkSession, directory: str, config: Config | None = None, mounts: str | None = None):
        self.spark, self.config, self.mounts, self.degraded = spark, config or Config(), mounts, False
        # what is not to persist lies in the shared folder until the engine is closed
        self.catalog = Catalog(spark, directory if self.config.persist_index else f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}")

    def close(self) -> None:
        if not self.config.persist_index:
            delete(self.spark, self.catalog.dir)

    def walk_options(self) -> walk.WalkOptions:
        """The settings' walk, without the mounts that they exclude; a mount that is a root or holds one stays."""
        options = self.config.walk_options()
        if self.mounts:
            table = read_mounts(self.spark, self.mounts)
            out = mounts_excluded(table, options.roots, tuple(self.config.extra_excluded_fstypes), self.config.exclude_network, self.config.exclude_removable)
            options.excluded += [r["point"] for r in out.select("point").distinct().orderBy("point").collect()]  # a mount table is short
        return options

    def start(self) -> Engine:
        """Builds the catalog unless the one that is there was walked with the same options."""
        if self.catalog.needs_rebuild(self.walk_options().fingerprint()):
            self.rebuild()
        return self

    def rebuild(self) -> dict:
        options = self.walk_options()
        return self.catalog.rebuild(walk.walk(self.spark, options), options.fingerprint(), roots=walk.root_times(options))

    def apply(self, delta: DataFrame) -> None:
        if not self.config.paused:
            self.catalog.apply(delta)
            self.catalog.compact(self.config.overlay_compaction_threshold)

    def rescan(self, quick: bool = False) -> int:
        """Walks again and applies what differs, for a tree that nobody watches; how many entries differed. Texts of changed and removed files go.

        quick: lists only directories whose times have changed, so that a tree in which little came or went costs little; files that were written in place
        are found by the next whole walk.
        """
        if self.config.paused:
            return 0
        began, options, seq = int(time.time()), self.walk_options(), self.catalog.next_seq()
        roots, last = walk.root_times(options), self.catalog.commit()
        if quick and last and last["walk_key"] == options.fingerprint() and not options.follow_symlinks:
            # what a root's time was before is known for roots that were walked; others are listed
            known = {root: last["roots"].get(root, -1) for root in roots}
            found, _ = walk.quick_changes(self.catalog.files(), known, options, last["walked_at"], seq)
        else:
            found = walk.changes(self.catalog.entries(), walk.walk(self.spark, options), seq)
        found = checkpointed(found)
        n = found.count()
        if n:
            self.apply(found)
            if self.config.content_index:
                self.catalog.add_texts(found.select("path", F.lit(None).cast("string").alias("text"), "seq"))
        self.catalog.walked(began, roots)
        return n

    def rescans(self, times: int | None = None, sleep=time.sleep, whole_every: int = 1):
        """Rescans every rescan_interval_secs, at least RESCAN_LEAST apart: what is left when changes cannot be watched. Yields how many entries differed.

        Of whole_every rescans one is whole, the last of them; the others are quick.
        """
        self.degraded = True
        done = 0
        while times is None or done < times:
            sleep(max(self.RESCAN_LEAST, self.config.rescan_interval_secs))
            done += 1
            yield self.rescan(quick=done % whole_every != 0)

    def poll(self, query: Query, number: int, seen: str, now: int | None = None) -> DataFrame:
        """The rows of one search of `watch` whose paths no earlier one has reported. Reported paths lie in the folder `seen`, a folder a poll: a poll that is made again
        gives the same, and a watch goes on after a restart. The limit is that of one search, so a poll is small."""
        known = self.reported(seen).filter(F.col("poll") < number).select("path")
        at = f"{seen}/poll={number}"
        self.search(query, now).results.join(known, "path", "left_anti").coalesce(1).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(REPORTED).parquet(at)

    def reported(self, seen: str) -> DataFrame:
        """(path, size, mtime, is_dir, poll) of all that a watch has reported."""
        schema = f"{REPORTED}, poll long"
        return self.spark.read.schema(schema).parquet(seen) if listing(self.spark, seen) else self.spark.createDataFrame([], schema)

    def watch(self, query: Query, interval: int = 1, times: int | None = None, sleep=time.sleep, seen: str | None = None):
        """Searches every `interval` seconds, at least one; yields the rows of each time whose paths were not reported before. What is removed is not reported.

        With `seen`, a folder, a later watch goes on where this one ended; without, what was reported is forgotten at the end.
        """
        at = seen or f"{shared_dir(self.spark)}/watch-{uuid.uuid4().hex}"
        number = 1 + max((int(name.removeprefix("poll=")) for name, _ in listing(self.spark, at) if name.startswith("poll=")), default=-1)
        try:
            while times is None or times > 0:
                yield self.poll(query, number, at).collect()
                number += 1
                times = None if times is None else times - 1
                if times != 0:
                    sleep(max(1, interval))
        finally:
            if seen is None:
                delete(self.spark, at)

    def resume(self) -> dict:
        """Changes that came during a pause were not taken, so the catalog is built anew."""
        self.config = self.config.patched({"paused": False})
        return self.rebuild()

    def patch(self, patch: dict) -> bool:
        """New settings; one rebuild at the end if any of them changes what a walk finds. Texts go when they are no longer to be kept."""
        before = self.config
        self.config = before.patched(patch)
        if before.content_index and not self.config.content_index:
            self.catalog.clear_texts()
        changed = any(getattr(before, k) != getattr(self.config, k) for k in self.WALK_KEYS)
        if changed:
            self.rebuild()
        return changed

    def _texts(self, query: Query) -> DataFrame | None:
        """Texts for a content search: the cached ones, and of candidates without one the file as it is now."""
        if query.content is None:
            return None
        candidates = search.candidates(self.catalog.files(), query)
        cached = documents.within_cap(self.catalog.texts(with_seq=True), self.config.content_max_total_bytes).select("path", "text")
        return documents.cached_or_live(candidates, cached, self.config.content_max_file_bytes)

    def index_texts(self, directory: str, seq: int) -> None:
        """Extracts the texts of a directory into the catalog, if texts are to be kept."""
        if self.config.content_index:
            self.catalog.add_texts(documents.texts(self.spark, directory, self.config.content_max_file_bytes), seq)

    def search(self, query: Query, now: int | None = None, interactive: bool = False) -> search.SearchResult:
        """interactive: as typed by someone, where a short content pattern would match nearly everything."""
        if interactive and query.content is not None and len(query.content) < CONTENT_MIN:
            raise QueryError(f"a content pattern has {CONTENT_MIN} characters at least")
        if self.config.max_results:
            query = Query(**{**query.__dict__, "limit": min(query.limit, self.config.max_results)})
        if query.content is None:
            began = time.monotonic()
            rows = checkpointed(self.catalog.search(query, now, ("id", *search.RESULT)))
            truncated = rows.count() >= max(1, query.limit)
            return search.SearchResult(rows.orderBy("id").select(*search.RESULT), truncated, int((time.monotonic() - began) * 1000), self.catalog.counts()["files"])
        cap = self.config.candidate_cap or (CANDIDATE_CAP if interactive else None)
        return search.run(self.catalog.files(), query, self._texts(query), now, cap)

    def count(self, query: Query, now: int | None = None) -> int:
        return search.count(self.catalog.files(), query, now).first()["n"]

    def status(self) -> dict:
        return {**self.catalog.status(), "paused": self.config.paused, "degraded": self.degraded, "roots": self.config.walk_options().roots}


def handle(engine: Engine, line: str) -> str:
    """One request line to one answer line. Operations: search, count, status, rebuild, rescan, text_stats, clear_texts, config, set_config, pause, resume, ping."""
    try:
        request = json.loads(line)
        op = request.get("op")
        if op == "search":
            return export.envelope(engine.search(Query.from_json(json.dumps(request["query"]))))
        if op == "count":
            began = time.monotonic()
            n = engine.count(Query.from_json(json.dumps(request["query"])))
            return json.dumps({"count": n, "elapsed_ms": int((time.monotonic() - began) * 1000)})
        if op == "status":
            return json.dumps(engine.status())
        if op == "rebuild":
            return json.dumps(engine.rebuild())
        if op == "rescan":
            return json.dumps({"changed": engine.rescan()})
        if op == "clear_texts":
            engine.catalog.clear_texts()
            return json.dumps({"cleared": True})
        if op == "text_stats":
            return json.dumps(engine.catalog.text_stats().first().asDict())
        if op == "config":
            return json.dumps(asdict(engine.config))
        if op == "set_config":
            return json.dumps({"rebuilt": engine.patch(request["patch"])})
        if op == "pause":
            engine.config = engine.config.patched({"paused": True})
            return json.dumps({"paused": True})
        if op == "resume":
            return json.dumps(engine.resume())
        if op == "ping":
            return json.dumps({"ok": True})
        return json.dumps({"error": f"unknown op {op!r}"})
    except (QueryError, PatternError, KeyError, TypeError, ValueError) as e:
        return json.dumps({"error": str(e)})
