"""Roots, mounts and excluded names over a listing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlake.functions.paths import clean_prefix
from pathlake.operators.overlay import INLINE
from pathlake.operators.search import SMALL, small_side
from pathlake.schema import EXCLUDED_FSTYPES, EXCLUDED_NAMES, NETWORK_FSTYPES
from pathlake.sources.shared import checkpointed


class ExcludeNames:
    """Directory names that are left out anywhere, and path suffixes (items with a slash)."""

    def __init__(self, names: list[str], suffixes: list[str]):
        self.names, self.suffixes = names, suffixes

    @classmethod
    def parse(cls, text: str) -> ExcludeNames:
        """Items between commas and newlines; `#` items are comments; a slash at the end is dropped."""
        items = [i for i in (x.strip().rstrip("/") for x in re.split(r"[,\n\r]", text)) if i and not i.startswith("#")]
        return cls([i for i in items if "/" not in i], [i.strip("/") for i in items if "/" in i])

    @classmethod
    def default(cls) -> ExcludeNames:
        return cls.parse(",".join(EXCLUDED_NAMES))

    def matches(self, path: str) -> bool:
        return path.rsplit("/", 1)[-1] in self.names or any(path == s or path.endswith("/" + s) for s in self.suffixes)

    def column(self, path: Column) -> Column:
        """Whether a directory's path is excluded by its own name or by its last components."""
        out = F.element_at(F.split(path, "/"), -1).isin(self.names)
        for s in self.suffixes:
            out |= (path == s) | path.endswith("/" + s)
        return out


def pruned(files: DataFrame, exclude: ExcludeNames, index_hidden_dirs: bool = True, roots: tuple[str, ...] = ()) -> DataFrame:
    """A listing without excluded directories and all that lies in them; roots themselves are never left out, hidden files stay."""
    kept = [clean_prefix(r) for r in roots]
    above = lambda a: a.isin(kept) if kept else F.lit(False)
    out = lambda a: exclude.column(a) | (F.lit(not index_hidden_dirs) & a.rlike(r"(^|/)\.[^/]+$"))
    dirs = F.when(F.col("is_dir"), F.col("ancestors")).otherwise(F.slice("ancestors", 1, F.greatest(F.size("ancestors") - 1, F.lit(0))))
    # what lies above a root says nothing of it
    if kept:
        below = F.filter(dirs, lambda a: F.exists(F.array(*[F.lit(k) for k in kept]), lambda k: a.startswith(F.concat(k, F.lit("/")))))
    else:
        below = dirs
    return files.filter(~F.exists(below, lambda a: out(a) & ~above(a)))


def not_excluded(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows under none of the excluded paths: one array overlap a row, whatever the number of paths."""
    gone = [clean_prefix(p) for p in excluded]
    return files.filter(~F.arrays_overlap("ancestors", F.array(*[F.lit(p) for p in gone]))) if gone else files


def in_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Rows under any root."""
    return files.filter(F.arrays_overlap("ancestors", F.array(*[F.lit(clean_prefix(r)) for r in roots]))) if roots else files.limit(0)


def excluded_by(files: DataFrame, prefixes: DataFrame, column: str = "path") -> DataFrame:
    """Rows under none of the paths of a table, which may be large: an anti-join on equality over the ancestors.

    Up to INLINE paths are tested where the rows lie, up to SMALL are broadcast; what they hit, not the listing, is what is joined again.
    """
    gone = prefixes.select(F.col(column).alias("__above")).filter("__above IS NOT NULL").distinct()
    head = checkpointed(gone.limit(SMALL + 1))
    n = head.count()
    if n <= INLINE:
        return not_excluded(files, [r["__above"] for r in head.collect()])
    at = files.select("path", F.explode("ancestors").alias("__above"))
    hit = at.join(F.broadcast(head) if n <= SMALL else gone, "__above", "left_semi").select("path")
    return files.join(small_side(hit), "path", "left_anti")


def mounts_excluded(mounts: DataFrame, roots: list[str], fstypes: tuple[str, ...] = (), exclude_network: bool = True, exclude_removable: bool = True, removable: tuple[str, ...] = ()) -> DataFrame:
    """Of mounts (device, point, fstype), those that a walk leaves out: pseudo, network and removable ones, but none that is a root or holds one."""
    network = F.col("fstype").isin(NETWORK_FSTYPES)
    bad = F.col("fstype").isin([f for f in EXCLUDED_FSTYPES if f not in NETWORK_FSTYPES] + list(fstypes))
    if exclude_network:
        bad |= network
    if exclude_removable:
        bad |= F.col("point").rlike("^(/media|/run/media)/")
    if removable:
        bad |= F.col("device").isin(list(removable))
    holds = F.lit(False)
    for r in roots:
        p = clean_prefix(r)
        holds |= (F.col("point") == p) | (F.col("point") == "/") | F.lit(p).startswith(F.concat("point", F.lit("/")))
    return mounts.filter(bad & ~holds)


def effective_roots(roots: list[str], home: str) -> list[str]:
    """Configured roots, or the home directory; sorted, each once."""
    return sorted({clean_prefix(r) for r in roots if r}) or [clean_prefix(home)]
