"""What is derived from a path, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, UPPER, LOWER)


def name_of(path: Column) -> Column:
    """The last component; empty for the root."""
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    """The path above; "/" for what lies in the root, empty for a bare name and for the root itself."""
    above = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path == "/", "").when((above == "") & path.startswith("/"), "/").otherwise(above)


def extension_of(name: Column) -> Column:
    """What follows the last dot, in ASCII lower case; a dot at the start begins no extension."""
    return ascii_lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def hidden(path: Column) -> Column:
    """Whether any component begins with a dot and is longer than the dot."""
    return path.rlike(r"(^|/)\.[^/]")


def ancestors_of(path: Column) -> Column:
    """All paths above, from the root down, and the path itself: joins on prefixes become joins on equality."""
    parts = F.array_remove(F.split(path, "/"), "")
    lead = F.when(path.startswith("/"), "/").otherwise("")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(lead, F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(path.startswith("/"), F.array_distinct(F.concat(F.array(F.lit("/")), prefixes))).otherwise(prefixes)


def clean_prefix(path: str) -> str:
    """A path as a subtree's root: no slash at the end, but for the root itself."""
    return path.rstrip("/") or ("/" if path.startswith("/") else "")


def under(path: Column, root: str) -> Column:
    """Whether a path is root or below it, component by component. A range that Parquet statistics can prune, where possible."""
    p = clean_prefix(root)
    if p == "":
        return F.lit(True)
    return path.startswith("/") if p == "/" else (path == p) | path.startswith(p + "/")


def derive(entries: DataFrame) -> DataFrame:
    """entries (path, size, mtime, is_dir, others) with name, dir, ext, name_ext, is_hidden, parent_name, ancestors."""
    out = entries.withColumns({"name": name_of(F.col("path")), "dir": dir_of(F.col("path"))})
    out = out.withColumn("name_ext", extension_of(F.col("name")))
    return out.withColumns(
        {
            "ext": F.when(F.col("is_dir"), "").otherwise(F.col("name_ext")),
            "is_hidden": hidden(F.col("path")),
            "parent_name": name_of(F.col("dir")),
            "ancestors": ancestors_of(F.col("path")),
        }
    )
