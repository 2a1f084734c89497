"""Categories as predicates. They overlap, so they are conditions and not a grouping key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlake.plans.query import Category
from pathlake.schema import CATEGORY_EXTENSIONS


def predicate(category: Category, now: int) -> Column:
    """Rows of the category. Extensions are those of the path, so directories are not excluded; `Recent` wants a known time."""
    if category.kind == "All":
        return F.lit(True)
    if category.kind == "Recent":
        return (F.col("mtime") > 0) & (F.col("mtime") >= F.lit(now - category.param))
    if category.kind == "Large":
        return ~F.col("is_dir") & (F.col("size") >= F.lit(category.param))
    return F.col("name_ext").isin(CATEGORY_EXTENSIONS[category.kind])


#: Extension to type, for the Type column and MIME types of the commonest files.
MIME = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "mp3": "audio/mpeg", "mp4": "video/mp4", "json": "application/json", "csv": "text/csv"}


def mime(ext: Column) -> Column:
    pairs = [x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("application/octet-stream"))


def kind(ext: Column, is_dir: Column) -> Column:
    """The first category that has the extension."""
    out = F.when(is_dir, "Folder")
    for name, exts in CATEGORY_EXTENSIONS.items():
        out = out.when(ext.isin(exts), name)
    return out.otherwise("File")
