"""Search, counts, facets and ranking over a `files` DataFrame.

Everything is one filter (or one conditional aggregate) over the catalog: no Python runs on the executors. A `limit` always comes
with an order, so Spark keeps the best rows of each task and never sorts the whole result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlake.functions import categories, paths
from pathlake.plans.compiler import Compiled, compile_query
from pathlake.plans.query import Category, Query
from pathlake.schema import CATEGORY_EXTENSIONS
from pathlake.sources.shared import checkpointed

RESULT = ("path", "size", "mtime", "is_dir")
#: A side of a join of at most so many rows is broadcast.
SMALL = 200_000
#: Bytes of a large file.
LARGE = 100 << 20


def small_side(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small: up to SMALL rows it is computed once and stored; beyond that the planner decides."""
    head = checkpointed(df.limit(SMALL + 1))
    return F.broadcast(head) if head.count() <= SMALL else df


@dataclass
class SearchResult:
    results: DataFrame
    truncated: bool
    elapsed_ms: int
    indexed: int


def _compiled(query: Query | Compiled, now: int | None) -> Compiled:
    return query if isinstance(query, Compiled) else compile_query(query, int(time.time()) if now is None else now)


def matching(files: DataFrame, query: Query | Compiled, now: int | None = None) -> DataFrame:
    """All rows that the query accepts, content aside; without order or limit."""
    q = _compiled(query, now)
    return files.filter(q.predicate(files_only=q.query.content is not None))


def _with_text(files: DataFrame, doc_text: DataFrame | None) -> DataFrame:
    """files with `text`: their own column, or that of doc_text by path. A few candidates go to the texts, not the texts to them."""
    return files if doc_text is None else doc_text.select("path", "text").join(small_side(files), "path")


def content_matching(files: DataFrame, doc_text: DataFrame | None, query: Query | Compiled, now: int | None = None) -> DataFrame:
    """All rows that the query accepts by name and content, with `rank`: 0, or 1 for those found by content alone in an OR search.

    doc_text (path, text) holds the texts; None if files has them itself. Names are filtered before the join, so
    only candidates' texts are matched.
    """
    q = _compiled(query, now)
    if q.query.content_or_name and q.has_name_filter:
        rows = files.filter(q.coarse(files_only=True))
        rows = rows if doc_text is None else rows.join(doc_text.select("path", "text"), "path", "left")
        by_name = q.names()
        rows = rows.withColumn("rank", F.when(by_name, 0).when(F.coalesce(q.content(), F.lit(False)), 1)).filter("rank IS NOT NULL")
    else:
        rows = _with_text(files.filter(q.predicate(files_only=True)), doc_text).filter(q.content()).withColumn("rank", F.lit(0))
    return rows


def candidates(files: DataFrame, query: Query | Compiled, now: int | None = None) -> DataFrame:
    """(path) of the files whose content a query looks at."""
    q = _compiled(query, now)
    either = q.query.content_or_name and q.has_name_filter
    return files.filter(q.coarse(files_only=True) if either else q.predicate(files_only=True)).select("path")


def search(files: DataFrame, query: Query, doc_text: DataFrame | None = None, now: int | None = None, candidate_cap: int | None = None, columns: tuple[str, ...] = RESULT) -> DataFrame:
    """The query's rows in index order, at most `limit`; with a content pattern, of files whose text has it too.

    candidate_cap bounds the files whose content is looked at, as in the interactive engine; off by default.
    """
    q = _compiled(query, now)
    if query.content is None:
        return matching(files, q).orderBy("id").limit(q.limit).select(*columns)
    if candidate_cap is not None:
        pool = files.filter(q.coarse(True) if query.content_or_name else q.predicate(True)).orderBy("id").limit(max(q.limit, candidate_cap))
        files = pool
    return content_matching(files, doc_text, q).orderBy("rank", "id").limit(q.limit).select(*columns)


def run(files: DataFrame, query: Query, doc_text: DataFrame | None = None, now: int | None = None, candidate_cap: int | None = None) -> SearchResult:
    """search() with its envelope. `truncated` is set when as many rows as the limit are found, in OR searches when more are."""
    began = time.monotonic()
    q = _compiled(query, now)
    wider = Query(**{**query.__dict__, "limit": q.limit + 1})
    rows = checkpointed(search(files, wider, doc_text, q.now, candidate_cap, ("id", *RESULT)))
    n = rows.count()
    either = query.content is not None and query.content_or_name and q.has_name_filter
    out = rows.orderBy("id").limit(q.limit).select(*RESULT) if not either else rows.limit(q.limit).select(*RESULT)
    indexed = files.filter(~F.col("is_dir")).count()
    return SearchResult(out, n > q.limit if either else n >= q.limit, int((time.monotonic() - began) * 1000), indexed)


def count(files: DataFrame, query: Query, now: int | None = None) -> DataFrame:
    """One row, `n`: rows that the query accepts by name. The limit and the content pattern play no part, but a content query counts no directories."""
    return matching(files, query, now).agg(F.count("*").alias("n"))


def count_content(files: DataFrame, query: Query, doc_text: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """One row, `n`: rows that the query accepts by name and content."""
    return content_matching(files, doc_text, query, now).agg(F.count("*").alias("n"))


def counts(files: DataFrame) -> DataFrame:
    """One row: how many files and directories there are; zero for an empty catalog."""
    return files.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"))


def facets(files: DataFrame, query: Query, now: int, recent_secs: int = 604_800, large_bytes: int = LARGE, locations: dict[str, str] | None = None) -> DataFrame:
    """One row with a count for each category and for each named location, in one pass. Categories overlap; counts are by name."""
    cats = {"all": Category(), "recent": Category("Recent", recent_secs), "large": Category("Large", large_bytes), **{k.lower(): Category(k) for k in CATEGORY_EXTENSIONS}}
    cols = [F.count_if(categories.predicate(c, now)).alias(k) for k, c in cats.items()]
    cols += [F.count_if(paths.under(F.col("path"), p)).alias(k) for k, p in (locations or {}).items()]
    return matching(files, query, now).agg(*cols)


def root_counts(files: DataFrame, roots: list[str]) -> DataFrame:
    """(root, files, dirs) of every root, in one pass over the catalog; a path below two roots counts for both."""
    wanted = files.sparkSession.createDataFrame([(paths.clean_prefix(r),) for r in dict.fromkeys(roots)], "root string")
    each = files.select("is_dir", F.explode(F.filter("ancestors", lambda a: a.isin([paths.clean_prefix(r) for r in roots]))).alias("root"))
    found = each.groupBy("root").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"))
    return wanted.join(found, "root", "left").select("root", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("dirs", F.lit(0)).alias("dirs"))


#: Columns by which results are ordered, and the way they go first. `created` wants a listing with details.
SORTS = {
    "created": ("created", "desc"),
    "relevance": ("relevance", "desc"),
    "name": ("name", "asc"),
    "path": ("path", "asc"),
    "size": ("size", "desc"),
    "modified": ("mtime", "desc"),
    "extension": ("name_ext", "asc"),
}


def ranked(files: DataFrame, query: Query, by: str = "relevance", ascending: bool | None = None, now: int | None = None) -> DataFrame:
    """The best `limit` rows by relevance, fuzzy score, name, path, size, time or extension; ties by name length, then path."""
    q = _compiled(query, now)
    rows = matching(files, q)
    if by == "fuzzy":
        rows, column, order = rows.withColumn("score", q.fuzzy_score()), "score", "desc"
    else:
        rows = rows.withColumn("relevance", q.relevance()).withColumn("match", q.match_count())
        column, order = SORTS[by]
    down = order == "desc" if ascending is None else not ascending
    first = F.col(column).desc() if down else F.col(column).asc()
    return rows.orderBy(first, F.char_length("name").asc(), F.col("path").asc()).limit(q.limit)


def within(results: DataFrame, text: str) -> DataFrame:
    """Of a result, the rows whose name or path has the text, case aside."""
    word = text.lower()
    return results.filter(F.lower("path").contains(word))


def lookup(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, size, mtime, is_dir) of every wanted path; zeros for one that isn't there."""
    meta = files.select(*RESULT)
    zero = {"size": F.lit(0).cast("long"), "mtime": F.lit(0).cast("long"), "is_dir": F.lit(False)}
    return wanted.select("path").join(meta, "path", "left").select("path", *[F.coalesce(c, z).alias(c) for c, z in zero.items()])


def empty_entries(files: DataFrame) -> DataFrame:
    """Empty files, and directories that hold nothing."""
    parents = files.select(F.col("dir").alias("path")).distinct()
    dirs = files.filter("is_dir").join(parents, "path", "left_anti")
    return files.filter(~F.col("is_dir") & (F.col("size") == 0)).select(*RESULT).unionByName(dirs.select(*RESULT))


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Of links (path, target), those whose target isn't in the catalog."""
    return links.join(files.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target")


#: Bytes of a file whose digest is taken on demand.
DIGEST_MAX = 512 << 20


def details(files: DataFrame, content: str = "text", largest: int = DIGEST_MAX) -> DataFrame:
    """(path, mime, sha256, modified) of each row: its type, the digest of its content unless it is over `largest` bytes, and its time as text in UTC."""
    day = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("mtime"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    digest = F.when(F.col("size") <= largest, F.sha2(F.col(content).cast("binary"), 256))
    return files.select("path", categories.mime(F.col("name_ext")).alias("mime"), digest.alias("sha256"), day.alias("modified"))


def row_columns(files: DataFrame) -> DataFrame:
    """The columns of a result list: type, MIME type and time as a timestamp."""
    return files.select(*RESULT, "name", categories.kind(F.col("name_ext"), F.col("is_dir")).alias("type"), categories.mime(F.col("name_ext")).alias("mime"), F.timestamp_seconds("mtime").alias("modified"))
