"""The stored catalog: snapshots, a change log, cached texts, and a record a commit.

    <dir>/snapshots/<name>/       files by id, some SNAPSHOT_ROWS to a Parquet file
    <dir>/manifests/<name>/       (file, first, last, n): the ids of each of its files
    <dir>/details/<name>/         what a walk with details knew of each path of a snapshot
    <dir>/changes/b=<name>/       a batch of changes, numbered
    <dir>/texts/b=<name>/         a batch of (path, text, seq) of extracted documents
    <dir>/commits/<number>.json   what the catalog is made of from then on; put only if it isn't there

Data lie in folders of their own names and count once a record names them, so a job that dies leaves the catalog as it was. Writers that
meet at a number are told apart by the store: the loser reads the winner's record and tries the next number, without writing its data again. vacuum() removes
what no late record names. A record's version counts snapshots. All of it goes through Spark or Hadoop's file systems, so the directory may be in any store.

Ids are stable. A snapshot from a walk has its paths' order; each change takes the next free number, so a path that a change brings comes after all
that were there, in order of (batch, seq, path), and keeps its id through later changes and compactions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.functions import categories
from pathlake.functions.paths import ancestors_of, derive
from pathlake.operators import overlay, search
from pathlake.operators.search import SMALL, small_side
from pathlake.plans.compiler import Compiled, compile_query
from pathlake.plans.query import Category, Query
from pathlake.schema import CATEGORY_EXTENSIONS, COMPACT_AT, DELTA, DETAILS, ENTRY, FILES, SCHEMA_VERSION
from pathlake.sources.shared import checkpointed, delete, listing, put_if_absent, read_text

TEXTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("seq", T.LongType())])
LOGGED = T.StructType([*DELTA.fields, T.StructField("ord", T.LongType()), T.StructField("b", T.StringType())])
MANIFEST = "file string, first long, last long, n long"
#: Rows of a file of a snapshot; batches of changes or texts that are merged into one beyond.
SNAPSHOT_ROWS, MOST_BATCHES = 65_536, 32
#: What the header counts: files, directories, and the categories that only a row's own values decide.
COUNTED = ("files", "dirs", "all", "large", *[c.lower() for c in CATEGORY_EXTENSIONS])


class Catalog:
    """A catalog in a directory. Opening reads its last commit; files() is its latest state with all changes so far."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.dir, self.paused = spark, directory.rstrip("/"), False
        self._records: dict[str, dict] = {}
        self._resolved: tuple[list, DataFrame, DataFrame] | None = None

    # --- commits

    def _versions(self) -> list[str]:
        return [name for name, _ in listing(self.spark, f"{self.dir}/commits") if name.endswith(".json")]

    def _record(self, name: str) -> dict:
        if name not in self._records:  # records never change
            self._records[name] = json.loads(read_text(self.spark, f"{self.dir}/commits/{name}"))
        return self._records[name]

    def _last(self) -> dict:
        """The last record, of whatever schema; one without a snapshot if there is none."""
        empty = {"commit": 0, "version": 0, "snapshot": None, "details": None, "complete": False, "walk_key": "", "walked_at": 0, "roots": {}, "built_at": 0, "base_seq": -1, "last_seq": -1, "next_id": 1, "changes": [], "texts": [], "header": dict.fromkeys(COUNTED, 0), "counts": None}
        names = self._versions()
        if not names:
            return empty
        last = self._record(names[-1])
        return last if last["schema_version"] == SCHEMA_VERSION else empty | {"commit": last["commit"]}

    def commit(self) -> dict | None:
        """The last commit's record; None before the first snapshot."""
        last = self._last()
        return last if last["complete"] else None

    def _publish(self, make: Callable[[dict], dict | None]) -> dict | None:
        """The next record: make(last record) says what changes. Another writer's record that came first is read, and make is asked anew; None gives up."""
        while True:
            last = self._last()
            changed = make(last)
            if changed is None:
                return None
            record = last | {"schema_version": SCHEMA_VERSION} | changed | {"commit": last["commit"] + 1}
            if put_if_absent(self.spark, f"{self.dir}/commits/{record['commit']:012}.json", json.dumps(record)):
                return record

    def needs_rebuild(self, walk_key: str) -> bool:
        c = self.commit()
        return c is None or c["walk_key"] != walk_key

    # --- writing

    def _write_snapshot(self, rows: DataFrame) -> str:
        """rows (with ids), in order of ids; the snapshot's name."""
        name = uuid.uuid4().hex
        ordered = rows.select(*FILES.names).repartitionByRange("id").sortWithinPartitions("id")
        ordered.write.option("maxRecordsPerFile", SNAPSHOT_ROWS).parquet(f"{self.dir}/snapshots/{name}")
        stored = self.spark.read.schema(FILES).parquet(f"{self.dir}/snapshots/{name}").select("id", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
        ids = stored.groupBy("file").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        ids.coalesce(1).write.parquet(f"{self.dir}/manifests/{name}")  # a row a file
        return name

    def rebuild(self, entries: DataFrame, walk_key: str = "", base_seq: int | None = None, roots: dict[str, int] | None = None) -> dict:
        """A new snapshot of entries (path, size, mtime, is_dir), each path once. Changes up to base_seq (by default: all so far) are held to be in it.

        roots: the times of the walk's roots, for a later look at what changed; they must be read before the walk.
        """
        began = int(time.time())
        before = self._last()
        base_seq = before["last_seq"] if base_seq is None else base_seq
        known = {b["name"] for b in before["changes"] if b["last_seq"] <= base_seq}
        if more := [c for c in DETAILS.names if c in entries.columns and c not in overlay.META]:
            entries = checkpointed(entries)  # listed once
        rows = derive(overlay.assign_ids(entries.select("path", "size", "mtime", "is_dir").dropDuplicates(["path"])))
        name = self._write_snapshot(rows)
        if more:
            known = entries.select("path", *more).dropDuplicates(["path"])
            known.repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{self.dir}/details/{name}")
        counts, n = self._counted(self._stored(name)), self._manifest(name).agg(F.sum("n")).first()[0] or 0

        def make(last: dict) -> dict:
            return {
                "version": last["version"] + 1, "snapshot": name, "details": name if more else None, "complete": True, "walk_key": walk_key, "walked_at": began, "roots": roots or {}, "built_at": int(time.time()), "base_seq": base_seq, "next_id": max(last["next_id"], n + 1),
                "changes": [b for b in last["changes"] if b["name"] not in known], "header": counts, "counts": None,
            }

        record = self._publish(make)
        self.vacuum()
        return record

    def apply(self, delta: DataFrame) -> dict | None:
        """Appends changes, which get the next ids in order of (seq, path). Of several feeds, all must number their changes together (see next_seq)."""
        numbered = overlay.assign_ids(delta.select(*DELTA.names), ("seq", "path"), 0).withColumnRenamed("id", "ord")
        name = uuid.uuid4().hex
        numbered.select(*DELTA.names, "ord").write.parquet(f"{self.dir}/changes/b={name}")
        rows = self.spark.read.schema(LOGGED).option("basePath", f"{self.dir}/changes").parquet(f"{self.dir}/changes/b={name}")
        n, first, last_seq = rows.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        if not n:
            return None
        batch = {"name": name, "n": n, "first_seq": first, "last_seq": last_seq}

        def make(last: dict) -> dict:
            return {"changes": [*last["changes"], batch | {"first_id": last["next_id"]}], "next_id": last["next_id"] + n, "last_seq": max(last["last_seq"], last_seq), "counts": None}

        record = self._publish(make)
        if len(record["changes"]) > MOST_BATCHES:
            self._merge_batches(record)
        return record

    def walked(self, at: int, roots: dict[str, int]) -> None:
        """Records that the tree was looked at, at a time, when its roots had these times."""
        self._publish(lambda last: {"walked_at": at, "roots": roots})

    def next_seq(self) -> int:
        """A number for changes that come now: above that of any change so far."""
        return self._last()["last_seq"] + 1

    def _merge_batches(self, at: dict) -> None:
        """Rewrites the log as one batch, so that many small batches don't leave many small files."""
        names = [b["name"] for b in at["changes"]]
        first = min(b["first_id"] for b in at["changes"])
        name = uuid.uuid4().hex
        self._log(at).select(*DELTA.names, (F.col("id") - first).alias("ord")).coalesce(8).write.parquet(f"{self.dir}/changes/b={name}")
        whole = {"name": name, "n": sum(b["n"] for b in at["changes"]), "first_id": first, "first_seq": min(b["first_seq"] for b in at["changes"]), "last_seq": max(b["last_seq"] for b in at["changes"])}

        def make(last: dict) -> dict | None:
            if [b["name"] for b in last["changes"][: len(names)]] != names:
                return None  # a rebuild or another merge came first
            return {"changes": [whole, *last["changes"][len(names) :]]}

        self._publish(make)

    def compact(self, threshold: int = COMPACT_AT, renumber: bool = False) -> bool:
        """A snapshot from snapshot and changes, once over `threshold` paths have changed. Ids stay; with renumber they follow the paths again."""
        c = self.commit()
        if c is None or sum(b["n"] for b in c["changes"]) <= threshold or self.dirty() <= threshold:
            return False
        if renumber:
            self.rebuild(self.entries(), c["walk_key"])
            return True
        name = self._write_snapshot(self.files())
        folded = {b["name"] for b in c["changes"]}
        base_seq, counts = max(b["last_seq"] for b in c["changes"]), self._counted(self._stored(name))

        def make(last: dict) -> dict | None:
            if last["snapshot"] != c["snapshot"] or not folded <= {b["name"] for b in last["changes"]}:
                return None  # a rebuild or a merge of batches came first: this snapshot is out of date
            left = [b for b in last["changes"] if b["name"] not in folded]
            return {"version": last["version"] + 1, "snapshot": name, "base_seq": base_seq, "built_at": int(time.time()), "changes": left, "header": counts, "counts": None}

        done = self._publish(make) is not None
        self.vacuum()
        return done

    def vacuum(self, keep: int = 2, age: int = 3600) -> None:
        """Removes what none of the last `keep` records names, and older records. What is younger than `age` seconds stays: its record may be about to come."""
        late = [self._record(n) for n in self._versions()[-keep:]]
        old = (time.time() - age) * 1000
        named = {
            "snapshots": {r.get("snapshot") for r in late},
            "manifests": {r.get("snapshot") for r in late},
            "details": {r.get("details") for r in late},
            "changes": {f"b={b['name']}" for r in late for b in r["changes"]},
            "texts": {f"b={b}" for r in late for b in r["texts"]},
            "commits": {f"{r['commit']:012}.json" for r in late},
        }
        for folder, names in named.items():
            for name, changed in listing(self.spark, f"{self.dir}/{folder}"):
                if name not in names and changed <= old:
                    delete(self.spark, f"{self.dir}/{folder}/{name}")

    # --- texts

    def add_texts(self, texts: DataFrame, seq: int | None = None) -> None:
        """Appends texts (path, text), with their own `seq` or one for all. The text with the greatest seq of a path counts; a null text removes it."""
        number = F.col("seq") if seq is None else F.lit(seq)
        name = self._write_texts(texts.select("path", "text", number.cast("long").alias("seq")))
        record = self._publish(lambda last: {"texts": [*last["texts"], name]})
        if len(record["texts"]) > MOST_BATCHES:
            merged = self._write_texts(self._last_texts(record))
            names = record["texts"]
            self._publish(lambda last: {"texts": [merged, *last["texts"][len(names) :]]} if last["texts"][: len(names)] == names else None)
            self.vacuum()

    def _write_texts(self, texts: DataFrame) -> str:
        name = uuid.uuid4().hex
        texts.write.parquet(f"{self.dir}/texts/b={name}")
        return name

    def remove_texts_under(self, roots: DataFrame, seq: int) -> None:
        """Removes the cached texts below the given paths."""
        gone = self._under(self.texts(), roots).select("path", F.lit(None).cast("string").alias("text"))
        self.add_texts(checkpointed(gone), seq)

    def clear_texts(self) -> None:
        self._publish(lambda last: {"texts": []})

    def _last_texts(self, at: dict) -> DataFrame:
        """(path, text, seq): the last text of each path, null where it was removed."""
        if not at["texts"]:
            return self.spark.createDataFrame([], TEXTS)
        t = self.spark.read.schema(TEXTS).parquet(*[f"{self.dir}/texts/b={b}" for b in at["texts"]])
        # max_by leaves a null text in its place, where it stands for a removal
        return t.groupBy("path").agg(F.max_by("text", F.struct("seq", "text")).alias("text"), F.max("seq").alias("seq"))

    def texts(self, with_seq: bool = False) -> DataFrame:
        """(path, text) or (path, text, seq): the last text of each path that is still there."""
        last = self._last_texts(self._last()).filter("text IS NOT NULL").join(self.files().select("path"), "path", "left_semi")
        return last if with_seq else last.drop("seq")

    # --- reading

    def _stored(self, name: str | None, *files: str) -> DataFrame:
        if name is None:
            return self.spark.createDataFrame([], FILES)
        at = f"{self.dir}/snapshots/{name}"
        return self.spark.read.schema(FILES).parquet(*([f"{at}/{f}" for f in files] or [at]))

    def _manifest(self, name: str | None) -> DataFrame:
        return self.spark.createDataFrame([], MANIFEST) if name is None else self.spark.read.schema(MANIFEST).parquet(f"{self.dir}/manifests/{name}")

    def snapshot(self) -> DataFrame:
        return self._stored(self._last()["snapshot"])

    def _log(self, at: dict) -> DataFrame:
        """The changes of a record's batches, with the id that each has taken."""
        if not at["changes"]:
            return self.spark.createDataFrame([], T.StructType([*DELTA.fields, T.StructField("id", T.LongType())]))
        rows = self.spark.read.schema(LOGGED).option("basePath", f"{self.dir}/changes").parquet(*[f"{self.dir}/changes/b={b['name']}" for b in at["changes"]])
        firsts = F.create_map(*[F.lit(x) for b in at["changes"] for x in (b["name"], b["first_id"])])
        return rows.select(*DELTA.names, (F.element_at(firsts, F.col("b")) + F.col("ord")).alias("id"))

    def changes(self) -> DataFrame:
        """The changes that no snapshot holds yet."""
        at = self._last()
        return self._log(at).filter(F.col("seq") > at["base_seq"]).select(*DELTA.names)

    def _pending(self, at: dict) -> tuple[DataFrame | None, DataFrame | None]:
        """(added, gone) of a record's changes: rows as the changes leave them, with their ids, and the removed subtrees. None without changes.

        A path that the snapshot has keeps its id there. Up to SMALL changes both are stored and sent to the snapshot, which is then only scanned: no row of it is
        shuffled. They are kept for the next query over the same.
        """
        if not at["changes"]:
            return None, None
        key = [at["snapshot"], at["changes"]]
        if self._resolved and self._resolved[0] == key:
            return self._resolved[1:]
        log = self._log(at).filter(F.col("seq") > at["base_seq"])
        first = log.filter("op = 'upsert'").groupBy("path").agg(F.min("id").alias("new_id"))
        last = overlay.latest(log.drop("id")).filter("op = 'upsert'").join(first, "path")
        few = sum(b["n"] for b in at["changes"]) <= SMALL
        last = checkpointed(last) if few else last
        old = self._stored(at["snapshot"]).select("path", "id").join(F.broadcast(last.select("path")) if few else last.select("path"), "path", "left_semi")
        rows = last.join(old, "path", "left").withColumn("id", F.coalesce("id", "new_id"))
        gone = checkpointed(overlay.tombstones(log)) if few else overlay.tombstones(log)
        added = derive(rows.select("id", *overlay.META, "seq"))
        added = checkpointed(added) if few else added
        self._resolved = (key, added, gone)
        return added, gone

    def _merged(self, at: dict, base: DataFrame, ids: tuple[int, int] | None = None) -> DataFrame:
        """base, which is the snapshot or those of its files that hold `ids`, with the changes to it; without `ids` with new paths too."""
        added, gone = self._pending(at)
        if added is None:
            return base
        few = sum(b["n"] for b in at["changes"]) <= SMALL
        known = added.select("path")
        kept = base.join(F.broadcast(known) if few else known, "path", "left_anti").withColumn("seq", F.lit(at["base_seq"]).cast("long"))
        here = added if ids is None else added.filter(F.col("id").between(*ids))
        return overlay.alive(kept.unionByName(here.select(*kept.columns)), gone).select(*FILES.names)

    def files(self) -> DataFrame:
        """The catalog with all changes applied. Ids are the snapshot's; new paths come after them, in order of their changes."""
        at = self._last()
        return self._merged(at, self._stored(at["snapshot"]))

    def detailed(self) -> DataFrame:
        """files() with created, owner, group, permissions, inode and links, as the last walk with details found them; null where it knew them not, as for paths that came since."""
        at = self._last()
        if at.get("details") is None:
            return self.files().select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in DETAILS.fields[len(ENTRY.fields) :]])
        known = self.spark.read.parquet(f"{self.dir}/details/{at['details']}")
        return self.files().join(known, "path", "left")

    def pending_texts(self) -> DataFrame:
        """(path, seq) of files that a change since the snapshot brought or wrote, and whose text is not extracted yet: what an extraction stream is behind by."""
        at = self._last()
        last = overlay.latest(self.changes()).filter("op = 'upsert' AND NOT is_dir").select("path", "seq")
        done = self._last_texts(at).select("path", F.col("seq").alias("text_seq"))
        return last.join(done, "path", "left").filter("text_seq IS NULL OR text_seq < seq").select("path", "seq")

    def entries(self) -> DataFrame:
        """(path, size, mtime, is_dir) with all changes applied."""
        return self.files().select(*overlay.META)

    def search(self, query: Query, now: int | None = None, columns: tuple[str, ...] = search.RESULT) -> DataFrame:
        """The query's first `limit` rows by id, by name alone. Files of the snapshot are read in order of ids, twice as many each time, until the
        limit is met: a frequent name costs a file or two, whatever the size of the catalog."""
        at, q = self._last(), _compiled(query, now)
        found, left = [], q.limit

        def take(rows: DataFrame) -> None:
            nonlocal left
            found.append(checkpointed(search.matching(rows, q).orderBy("id").limit(left).select("id", *[c for c in columns if c != "id"])))
            left -= found[-1].count()

        files = self._manifest(at["snapshot"]).orderBy("first").collect()  # a row a file
        step, done = 1, 0
        while left > 0 and done < len(files):
            some = files[done : done + step]
            take(self._merged(at, self._stored(at["snapshot"], *[f["file"] for f in some]), (some[0]["first"] if done else 0, files[done + step]["first"] - 1 if done + step < len(files) else some[-1]["last"])))
            done, step = done + step, step * 2
        added, gone = self._pending(at)
        if left > 0 and added is not None:
            take(overlay.alive(added.filter(F.col("id") > (files[-1]["last"] if files else 0)), gone))
        rows = found[0] if found else self.spark.createDataFrame([], FILES)
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows.orderBy("id").limit(q.limit).select(*columns)

    # --- counts

    def _counted(self, files: DataFrame) -> dict[str, int]:
        """The header's counts, by a scan."""
        cats = {"all": Category(), "large": Category("Large", search.LARGE), **{k.lower(): Category(k) for k in CATEGORY_EXTENSIONS}}
        cols = [F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), *[F.count_if(categories.predicate(c, 0)).alias(k) for k, c in cats.items()]]
        return files.agg(*cols).first().asDict()

    def counts(self) -> dict[str, int]:
        """How many files and directories there are, and how many rows in each category. The record has them, and no row is read; after changes the snapshot's
        header is corrected once, by what lies between the least and the greatest changed path before and after, and recorded."""
        at = self._last()
        if at["counts"] is None:
            counts = at["header"]
            if at["changes"]:
                lo, hi = self.changes().agg(F.min("path"), F.max(F.concat("path", F.lit("0")))).first()  # "0" is next to "/", so a subtree is in between
                near = self._stored(at["snapshot"]).filter(F.col("path").between(lo, hi)) if lo is not None else self._stored(None)
                before, after = self._counted(near), self._counted(self._merged(at, near))
                counts = {k: counts[k] - before[k] + after[k] for k in COUNTED}
            self._publish(lambda last: {"counts": counts} if last["commit"] == at["commit"] else None)
            return counts
        return at["counts"]

    def facets(self, query: Query, now: int, recent_secs: int = 604_800) -> DataFrame:
        """search.facets(); without a condition it reads recent rows alone, as the record has the rest."""
        if Query(**{**query.__dict__, "limit": Query().limit}) != Query():
            return search.facets(self.files(), query, now, recent_secs)
        counts, recent = self.counts(), self.files().filter(categories.predicate(Category("Recent", recent_secs), now))
        cols = ["all", "recent", "large", *[k.lower() for k in CATEGORY_EXTENSIONS]]
        return recent.agg(F.count("*").alias("recent")).select(*["recent" if k == "recent" else F.lit(counts[k]).cast("long").alias(k) for k in cols])

    def dirty(self) -> int:
        """How many paths have a change that no snapshot holds yet."""
        return overlay.dirty(self.changes()).first()["n"]

    def status(self) -> dict:
        c, n = self.commit(), self.counts()
        shown = {k: c[k] for k in ("version", "schema_version", "complete", "built_at", "walk_key", "base_seq")} if c else {}
        return {"state": "Live" if c else "Starting", "files": n["files"], "dirs": n["dirs"], "dirty": self.dirty(), "paused": self.paused, **shown}

    # --- texts below paths

    def _under(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        at = rows.select("path", F.explode(ancestors_of(F.col("path"))).alias("root"))
        return at.join(small_side(roots.select(F.col("path").alias("root"))), "root", "left_semi").select("path").distinct()

    def drop_texts_under(self, roots: DataFrame) -> DataFrame:
        """texts() without those below the given paths."""
        return self.texts().join(self._under(self.texts(), roots), "path", "left_anti")

    def text_stats(self) -> DataFrame:
        return self.texts().agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def _compiled(query: Query, now: int | None) -> Compiled:
    return compile_query(query, int(time.time()) if now is None else now)
