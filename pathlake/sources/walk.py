"""Directory walks as a Spark data source: `spark.read.format("walk").option("roots", ...).load()`.

The driver lists directories from the top until there are PARTS subtrees, however they lie, and each subtree is a partition, so that executors walk
side by side; they must see the file system that is walked (a shared mount on a cluster). Spark's own file listing is of no use here: it drops
names that begin with a dot or an underscore, and directories.
"""

from __future__ import annotations

import json
import operator
import os
import time
from collections import deque
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from pathlake.functions import paths
from pathlake.operators.exclusions import ExcludeNames
from pathlake.operators.search import SMALL
from pathlake.plans.compiler import Compiled, compile_query
from pathlake.plans.query import Query
from pathlake.schema import DELTA, DETAILS, ENTRY, EVENT
from pathlake.sources.ignore import IGNORE_FILES, Ignore
from pathlake.sources.shared import checkpointed

#: Subtrees that a walk is split into, if there are so many.
PARTS = 64
#: Conditions on an entry's columns that a walk tests by itself.
COMPARE = {"=": operator.eq, ">=": operator.ge, "<=": operator.le}


@dataclass
class WalkOptions:
    roots: list[str] = field(default_factory=list)
    respect_ignore: bool = True
    follow_symlinks: bool = False
    index_hidden_dirs: bool = False
    exclude_names: str | None = None  # None: the built-in list
    excluded: list[str] = field(default_factory=list)  # subtrees that are left out
    dirs_only: bool = False
    global_ignore: str | None = None  # text of one more ignore file, for all roots
    details: bool = False  # also creation time, owner, group, mode, inode and number of links
    under: str = ""  # only this path and what lies below it
    tests: list = field(default_factory=list)  # only entries that pass each (column, one of COMPARE, value)

    def names(self) -> ExcludeNames:
        return ExcludeNames.default() if self.exclude_names is None else ExcludeNames.parse(self.exclude_names)

    def fingerprint(self) -> str:
        """Changes with every option that changes what a walk finds."""
        import hashlib

        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True).encode()).hexdigest()


def _entry(path: str, st: os.stat_result, is_dir: bool, details: bool = False) -> tuple:
    plain = path, 0 if is_dir else st.st_size, max(0, int(st.st_mtime)), is_dir
    if not details:
        return plain
    born = getattr(st, "st_birthtime", None)  # where the system knows it
    return *plain, None if born is None else int(born), _name_of("pwd", st.st_uid), _name_of("grp", st.st_gid), st.st_mode & 0o7777, st.st_ino, st.st_nlink


def _name_of(module: str, number: int) -> str:
    """The name of a user or group; its number where the system has none."""
    import grp
    import pwd

    try:
        return pwd.getpwuid(number).pw_name if module == "pwd" else grp.getgrgid(number).gr_name
    except KeyError:
        return str(number)


class Walker:
    """Walks subtrees; counts what it could not read in `skipped`."""

    def __init__(self, options: WalkOptions):
        self.o, self.exclude, self.skipped = options, options.names(), 0
        self.gone = {paths.clean_prefix(p) for p in options.excluded}

    def ignore_in(self, directory: str, above: Ignore) -> Ignore:
        if not self.o.respect_ignore:
            return above
        # later ones win: what a repository excludes by itself, then the files that lie in the directory
        found = (_text_of(os.path.join(directory, name)) for name in (".git/info/exclude", *IGNORE_FILES))
        return above.enter(directory, [t for t in found if t is not None])

    def prunes(self, path: str, name: str) -> bool:
        hidden = name.startswith(".") and len(name) > 1
        return path in self.gone or (hidden and not self.o.index_hidden_dirs) or self.exclude.matches(path)

    def children(self, directory: str, ignore: Ignore):
        """(entry, whether it is a directory to walk) of what a directory holds, in order of names."""
        try:
            with os.scandir(directory) as it:
                found = sorted(it, key=lambda e: e.name)
        except OSError:
            self.skipped += 1
            return
        for e in found:
            try:
                link = e.is_symlink()
                is_dir = e.is_dir(follow_symlinks=self.o.follow_symlinks)
                st = e.stat(follow_symlinks=self.o.follow_symlinks)
            except OSError:
                self.skipped += 1
                continue
            if e.path in self.gone or ignore.ignores(e.path, is_dir) or (is_dir and self.prunes(e.path, e.name)):
                continue
            if is_dir or not self.o.dirs_only:
                yield _entry(e.path, st, is_dir, self.o.details), is_dir, link

    def walk(self, directory: str, ignore: Ignore, seen: frozenset = frozenset(), leads=None):
        """All entries under a directory, but for directories that `leads` refuses. Links that lead back to a directory above are not followed again."""
        stack = [(directory, ignore, seen)]
        while stack:
            at, above, met = stack.pop()
            rules = self.ignore_in(at, above)
            deeper = []
            for entry, is_dir, link in self.children(at, rules):
                yield entry
                if is_dir and (leads is None or leads(entry[0])):
                    real = os.path.realpath(entry[0]) if self.o.follow_symlinks else entry[0]
                    if link and (real in met or os.path.realpath(at).startswith(real.rstrip("/") + "/")):
                        continue
                    deeper.append((entry[0], rules, met | {real} if self.o.follow_symlinks else met))
            stack += reversed(deeper)

    def rules_above(self, directory: str) -> Ignore:
        """The rules that hold above a directory: the user's own, and those of the directories up to the root."""
        out = Ignore()
        if self.o.respect_ignore:
            out = out.enter("/", [t for t in (git_global_ignore(), self.o.global_ignore) if t])
            up = []
            at = os.path.dirname(directory)
            while at and at != directory:
                up.append(at)
                directory, at = at, os.path.dirname(at)
            for d in reversed(up):
                out = self.ignore_in(d, out)
        return out


def _text_of(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def git_global_ignore() -> str | None:
    """The text of the ignore file that git holds for all of a user's repositories: core.excludesFile, or git/ignore in the configuration folder."""
    home = os.path.expanduser("~")
    conf = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    named = None
    for path in (os.path.join(conf, "git/config"), os.path.join(home, ".gitconfig")):
        section = ""
        for line in (_text_of(path) or "").split("\n"):
            line = line.strip()
            if line.startswith("["):
                section = line.strip("[]").strip().lower()
            elif section == "core" and "=" in line and (kv := line.split("=", 1))[0].strip().lower() == "excludesfile":
                named = kv[1].strip().strip('"')
    return _text_of(os.path.expanduser(named)) if named else _text_of(os.path.join(conf, "git/ignore"))


class WalkPartition(InputPartition):
    def __init__(self, directory: str, deep: bool):
        self.directory, self.deep = directory, deep


class WalkReader(DataSourceReader):
    """A walk. With the options' `under`, directories outside that subtree are not entered; entries that fail one of its tests aren't sent."""

    def __init__(self, options: WalkOptions):
        self.options, self.top = options, paths.clean_prefix(options.under)

    def wanted(self, entry: tuple) -> bool:
        inside = self.top in ("", "/") or entry[0] == self.top or entry[0].startswith(self.top + "/")
        return inside and all(COMPARE[how](entry[ENTRY.names.index(column)], value) for column, how, value in self.options.tests)

    def leads(self, directory: str) -> bool:
        """Whether what is wanted may lie in a directory."""
        if self.top in ("", "/"):
            return True
        at = directory.rstrip("/") + "/"
        return at.startswith(self.top + "/") or self.top.startswith(at)

    def partitions(self):
        """Partitions for subtrees, and for what lies directly in the directories above them. The uppermost are split first, until there are PARTS."""
        out, walker = [], Walker(self.options)
        below = deque()
        for root in dict.fromkeys(paths.clean_prefix(r) for r in self.options.roots):
            below.append((root, walker.rules_above(root), True))
        listed = 0
        while below and (below[0][2] or len(below) + len(out) < PARTS and listed < 4 * PARTS):
            directory, above, _ = below.popleft()
            if not self.leads(directory):
                continue
            rules = walker.ignore_in(directory, above)
            out.append(WalkPartition(directory, False))
            listed += 1
            # links are walked whole by one task, which alone knows where they lead back to
            for entry, is_dir, link in walker.children(directory, rules):
                if is_dir and not self.leads(entry[0]):
                    continue
                if is_dir and link:
                    out.append(WalkPartition(entry[0], True))
                elif is_dir:
                    below.append((entry[0], rules, False))
        out += [WalkPartition(directory, True) for directory, _, _ in below]
        return out or [WalkPartition("", False)]

    def read(self, partition):
        if not partition.directory:
            return
        walker = Walker(self.options)
        rules = walker.rules_above(partition.directory)
        if partition.deep:
            found = walker.walk(partition.directory, rules, leads=self.leads)
        else:
            found = (entry for entry, _, _ in walker.children(partition.directory, walker.ignore_in(partition.directory, rules)))
        for entry in found:
            if self.wanted(entry):
                yield entry


class WalkStreamReader(DataSourceStreamReader):
    """Events from comparing listings: every micro-batch walks again and reports what is new, changed or gone.

    Numbers of events follow the clock, so that they go on growing when a query is started again. With a `state` file the last listing and the
    events that are not committed yet are kept there: a query that is started again reports what changed while it was down, and what it had not
    finished. The listing is held by the driver, which suits trees of some million entries; larger ones are compared by tasks (see changes()).
    """

    def __init__(self, options: WalkOptions, state: str | None = None):
        self.options, self.state, self.pending = options, state, {}
        self.seq, self.last = 0, {}
        if state and (text := _text_of(state)):
            kept = json.loads(text)
            self.seq, self.last = kept["seq"], {e[0]: tuple(e) for e in kept["entries"]}
            self.pending = {first: ([tuple(r) for r in rows], last) for first, last, rows in kept["pending"]}
        self.first = min(self.pending, default=self.seq)

    def initialOffset(self):
        return {"seq": self.first}  # may be asked for after a first listing

    def latestOffset(self):
        walker, now = Walker(self.options), {}
        for root in self.options.roots:
            for e in walker.walk(paths.clean_prefix(root), walker.rules_above(paths.clean_prefix(root))):
                now[e[0]] = e
        events = [("create" if p not in self.last else "data", e) for p, e in now.items() if self.last.get(p) != e]
        events += [("remove", e) for p, e in self.last.items() if p not in now]
        if events:
            first = max(self.seq, time.time_ns() // 1000)
            rows = [(e[0], k, e[1], e[2], e[3], first + i) for i, (k, e) in enumerate(sorted(events, key=lambda x: x[1][0]))]
            self.seq, self.last = first + len(rows), now
            self.pending[first] = (rows, self.seq)
            self._keep()
        return {"seq": self.seq}

    def _keep(self) -> None:
        if self.state:
            with open(f"{self.state}.part", "w", encoding="utf-8") as f:
                json.dump({"seq": self.seq, "entries": list(self.last.values()), "pending": [[s, last, rows] for s, (rows, last) in self.pending.items()]}, f)
            os.replace(f"{self.state}.part", self.state)

    def partitions(self, start, end):
        rows = [r for s, (batch, _) in sorted(self.pending.items()) if start["seq"] <= s < end["seq"] for r in batch]
        return [EventPartition(rows[lo : lo + 10_000]) for lo in range(0, max(1, len(rows)), 10_000)]

    def commit(self, end):
        if done := [s for s, (_, last) in self.pending.items() if last <= end["seq"]]:
            for s in done:
                del self.pending[s]
            self._keep()

    def read(self, partition):
        yield from partition.rows


class EventPartition(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walk"

    def _options(self) -> WalkOptions:
        return WalkOptions(**json.loads(self.options["walk"])) if "walk" in self.options else WalkOptions(roots=[r for r in self.options.get("roots", "").split("\n") if r])

    def schema(self):
        return DETAILS if self._options().details else ENTRY

    def reader(self, schema):
        return WalkReader(self._options())


class WatchSource(WalkSource):
    @classmethod
    def name(cls) -> str:
        return "watch"

    def schema(self):
        return EVENT

    def streamReader(self, schema):
        return WalkStreamReader(self._options(), self.options.get("state"))


def walk(spark: SparkSession, options: WalkOptions) -> DataFrame:
    """(path, size, mtime, is_dir) of all that lies under the roots, with `details` more; each path once, however roots nest."""
    spark.dataSource.register(WalkSource)
    rows = spark.read.format("walk").option("walk", json.dumps(options.__dict__)).load()
    nested = any(a != b and b.startswith(a.rstrip("/") + "/") for a in options.roots for b in options.roots)
    return rows.dropDuplicates(["path"]) if nested else rows


def matching(spark: SparkSession, options: WalkOptions, query: Query | Compiled, now: int) -> DataFrame:
    """The entries of a walk that a query accepts by name, as rows of a catalog without ids. Only the query's subtree is listed, and its conditions on size, time and
    kind are tested where the entries are found. (The conditions are given with the walk, not pushed down by Spark: that would keep those of a DataFrame's first query for its next.)
    """
    q = query if isinstance(query, Compiled) else compile_query(query, now)
    tests = [["size", how, n] for how, n in ((">=", q.min_size), ("<=", q.max_size)) if n is not None]
    tests += [["is_dir", "=", False]] if not q.include_dirs else []
    tests += [["mtime", ">=", now - q.modified_within_secs]] if q.modified_within_secs is not None else []
    rows = walk(spark, replace(options, under=q.under or "", tests=tests))
    return paths.derive(rows).filter(q.predicate())


def events(spark: SparkSession, options: WalkOptions, state: str | None = None) -> DataFrame:
    """A stream of events, by walking again at each trigger; `state` is a file that outlives the query."""
    spark.dataSource.register(WatchSource)
    rows = spark.readStream.format("watch").option("walk", json.dumps(options.__dict__))
    return (rows.option("state", state) if state else rows).load()


def below(created: DataFrame, options: WalkOptions) -> DataFrame:
    """Changes for all that lies below directories of created (path, op, size, mtime, is_dir, seq): what was there before anyone watched them.

    Each directory is walked by the task that has its row, but for those that lie in another one, which finds them; entries take its seq.
    """

    def run(batches):
        walker = Walker(options)
        for rows in batches:
            out = []
            for path, seq in zip(rows["path"], rows["seq"]):
                out += [(e[0], "upsert", *e[1:4], seq) for e in walker.walk(path, walker.rules_above(path))]
            yield pd.DataFrame(out, columns=DELTA.names)

    dirs = created.filter("op = 'upsert' AND is_dir").groupBy("path").agg(F.max("seq").alias("seq"))
    above = dirs.select("path", F.explode(paths.ancestors_of(F.col("path"))).alias("up")).filter("up != path")
    inner = above.join(dirs.select(F.col("path").alias("up")), "up", "left_semi").select("path")
    return dirs.join(inner, "path", "left_anti").mapInPandas(run, DELTA)


LISTED = T.StructType([T.StructField("dir", T.StringType()), T.StructField("listed", T.BooleanType()), *ENTRY.fields])


def changed_dirs(dirs: DataFrame, options: WalkOptions, since: int) -> DataFrame:
    """(dir, listed, path, size, mtime, is_dir) of the directories of dirs (path, mtime) whose time isn't the known one: an entry a row, and with `listed`
    a row for the directory itself.

    Tasks ask for the time of each directory and list those that differ; the others cost one call each. A time of `since` or later may hide a change of the
    same second, so such directories are listed too. Directories that are gone give nothing: their parents show it.
    """

    def run(batches):
        walker = Walker(options)
        for rows in batches:
            out = []
            for path, known in zip(rows["path"], rows["mtime"]):
                try:
                    st = os.stat(path, follow_symlinks=options.follow_symlinks)
                except OSError:
                    continue
                now = max(0, int(st.st_mtime))
                if now != known or now >= since:
                    out.append((path, True, path, 0, now, True))
                    out += [(path, False, *e) for e, _, _ in walker.children(path, walker.ignore_in(path, walker.rules_above(path)))]
            yield pd.DataFrame(out, columns=LISTED.names)

    return dirs.select("path", F.col("mtime")).mapInPandas(run, LISTED)


def quick_changes(files: DataFrame, roots: dict[str, int], options: WalkOptions, since: int, seq: int) -> tuple[DataFrame, DataFrame]:
    """(changes, listed): what changed in a catalog's tree since time `since` as far as the times of its directories tell, and (path, mtime) of those that were listed.

    files is the catalog, which holds each directory's time from when it was last listed; roots maps the roots, which aren't in it, to theirs. What
    comes, goes or is renamed changes a directory's time; a file that was written in place, or a new rule in an ignore file, does not, and wants a full walk (changes()).
    Only listed directories' rows are compared; directories that are new are walked whole.
    """
    spark = files.sparkSession
    tops = spark.createDataFrame([(paths.clean_prefix(p), t) for p, t in roots.items()], "path string, mtime long")
    dirs = files.filter("is_dir").select("path", "mtime").unionByName(tops)
    found = checkpointed(changed_dirs(spread_out(dirs), options, since))
    listed = found.filter("listed").select("path", "mtime")
    few = F.broadcast if listed.count() <= SMALL else (lambda df: df)
    known = files.join(few(listed.select(F.col("path").alias("dir"))), "dir", "left_semi").select(*ENTRY.names)
    own = files.filter("is_dir").join(few(listed.select("path")), "path", "left_semi").select(*ENTRY.names)
    # a listed directory's row is in its parent's listing too, if that was listed
    now = found.filter("NOT listed").select(*ENTRY.names)
    alone = found.filter("listed").select(*ENTRY.names).join(tops.select("path"), "path", "left_anti").join(own.select("path"), "path", "left_semi").join(now.select("path"), "path", "left_anti")
    old = known.unionByName(own).dropDuplicates(["path"])
    found_changes = checkpointed(changes(old, now.unionByName(alone), seq))
    fresh = found_changes.filter("op = 'upsert' AND is_dir").join(files.filter("is_dir").select("path"), "path", "left_anti")
    return found_changes.unionByName(below(fresh, options)).dropDuplicates(["path"]), listed


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows that cost a call each, dealt to all cores: a catalog's directories may lie in one file."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1), "path")


def root_times(options: WalkOptions) -> dict[str, int]:
    """The times of the roots; -1 for one that isn't there."""
    out = {}
    for root in options.roots:
        try:
            out[paths.clean_prefix(root)] = int(os.stat(root).st_mtime)
        except OSError:
            out[paths.clean_prefix(root)] = -1
    return out


def changes(old: DataFrame, new: DataFrame, seq: int) -> DataFrame:
    """The changes that turn listing old into listing new (path, size, mtime, is_dir), compared side by side by path; all have this seq."""
    o, n = old.alias("o"), new.alias("n")
    same = F.struct("o.size", "o.mtime", "o.is_dir").eqNullSafe(F.struct("n.size", "n.mtime", "n.is_dir"))
    rows = o.join(n, F.col("o.path") == F.col("n.path"), "full").filter(F.col("o.path").isNull() | F.col("n.path").isNull() | ~same)
    gone = F.col("n.path").isNull()
    return rows.select(
        F.coalesce("n.path", "o.path").alias("path"),
        F.when(gone, "remove").otherwise("upsert").alias("op"),
        *[F.col(f"n.{c}").alias(c) for c in ("size", "mtime", "is_dir")],
        F.lit(seq).cast("long").alias("seq"),
    )
