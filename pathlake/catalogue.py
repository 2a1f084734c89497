"""Queries over the driver's tables, and the same in DuckDB's SQL.

`documents` is taken for a file system: a file a document, with a path made of its language, source and id, and the directories. Its catalog
is built once and stored; queries by name read it alone, queries by content read the texts.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlake.engine import Engine
from pathlake.functions import codecs, paths
from pathlake.operators import duplicates, exclusions, overlay, search, tags, trash
from pathlake.plans.compiler import compile_query
from pathlake.plans.query import Category, Query
from pathlake.schema import CATEGORY_EXTENSIONS as _EXTS
from pathlake.sources import archives, documents, export, mounts, walk
from pathlake.sources.catalog import Catalog
from pathlake.sources.shared import checkpointed, delete, shared_dir, stamp
from pathlake.sources.text_index import TextIndex
from pathlake.streaming import cdc, frames

#: Fixed values of the catalog view.
SUFFIXES = (".txt", ".md", ".PDF", ".rs", ".png", ".zip", ".mp3", ".mp4", ".tar.gz", "")
EPOCH = 1_704_067_200
NOW = EPOCH + 1000 * 3600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size, mtime, is_dir, text): documents as files."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 10 + 1).cast("int"))
    folder = F.concat(F.lit("/corpus/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.coalesce("source", F.lit("none")))
    name = F.concat(F.when(F.col("doc_id") % 17 == 0, ".").otherwise(""), F.lit("Doc-"), F.col("doc_id").cast("string"), suffix)
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(folder, F.lit("/"), name).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("mtime"),
        F.lit(False).alias("is_dir"),
        "text",
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with their texts, as a content search reads them: names are matched first, on what is derived from each row alone."""
    return paths.derive(corpus(spark, sf_dir))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk of the documents gives: files and their directories."""
    docs = corpus(spark, sf_dir).select("path", "size", "mtime", "is_dir")
    dirs = docs.select(paths.dir_of(F.col("path")).alias("path")).distinct()
    return docs.unionByName(dirs.select("path", F.lit(0).cast("long").alias("size"), F.lit(EPOCH).cast("long").alias("mtime"), F.lit(True).alias("is_dir")))


def stored(spark: SparkSession, sf_dir: str) -> Catalog:
    """The stored catalog of a folder's documents. It lies in the shared folder and is built by the first query that wants it, and again when the documents' files change."""
    catalog = Catalog(spark, f"{shared_dir(spark)}/catalog-{zlib.crc32(sf_dir.encode()):08x}")
    key = stamp(spark, f"{sf_dir}/documents.parquet")
    if catalog.needs_rebuild(key):
        catalog.rebuild(entries(spark, sf_dir), key)
    return catalog


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with derived columns, as it is stored: no query by name reads a text."""
    return stored(spark, sf_dir).snapshot()


FILES_SQL = f"""
WITH corpus AS (
  SELECT doc_id,
         concat('/corpus/', coalesce(lang, 'xx'), '/', coalesce(source, 'none'), '/', CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END, 'Doc-', doc_id::VARCHAR,
                CASE doc_id % 10 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))} END) AS path,
         strlen(text)::BIGINT AS size, ({EPOCH} + doc_id * 3600)::BIGINT AS mtime, false AS is_dir, text
  FROM documents
), entries AS (
  SELECT * FROM corpus
  UNION ALL
  SELECT -1 - min(doc_id), regexp_replace(path, '/[^/]*$', ''), 0, {EPOCH}, true, NULL FROM corpus GROUP BY 2
), named AS (
  SELECT *, row_number() OVER (ORDER BY path) AS id, string_split(path, '/')[-1] AS name, regexp_replace(path, '/[^/]*$', '') AS dir FROM entries
), files AS (
  SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS name_ext,
         CASE WHEN is_dir THEN '' ELSE lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) END AS ext,
         regexp_matches(path, '(^|/)\\.[^/]') AS is_hidden, string_split(dir, '/')[-1] AS parent_name
  FROM named
)
"""


def _sql(where: str, columns: str = "path, size, mtime, is_dir", tail: str = "") -> str:
    return f"{FILES_SQL} SELECT {columns} FROM files WHERE {where} {tail}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _search(name: str, q: Query, where: str, limited: bool = False) -> None:
    """Registers a name search: all rows that match or, if `limited`, the first `limit` by id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = files(spark, sf_dir)
        if limited:
            return search.search(catalog, q, now=NOW)
        return search.matching(catalog, q, now=NOW).select(*search.RESULT)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _sql(where, tail=f"ORDER BY id LIMIT {q.limit}" if limited else "")


SHOWN = "NOT is_hidden"
_search("search_flagship", Query(name="doc ext:pdf,md !9 size:>1KB", include_dirs=False, limit=50), f"{SHOWN} AND NOT is_dir AND contains(lower(name), 'doc') AND ext IN ('pdf', 'md') AND NOT contains(name, '9') AND size >= 1025", limited=True)
_search("search_substring_and", Query(name="doc 7"), f"{SHOWN} AND contains(lower(name), 'doc') AND contains(name, '7')")
_search("search_case_sensitive", Query(name="Doc PDF", case_sensitive=True), f"{SHOWN} AND contains(name, 'Doc') AND contains(name, 'PDF')")
_search("search_glob_ci", Query(name="*.pdf"), f"{SHOWN} AND regexp_matches(name, '^.*\\.pdf$', 'is')")
_search("search_glob_class", Query(name="doc-[1-3]?5*"), f"{SHOWN} AND regexp_matches(name, '^doc-[1-3].5.*$', 'is')")
_search("search_glob_alternation", Query(name="*.{rs,png}"), f"{SHOWN} AND regexp_matches(name, '^.*\\.(rs|png)$', 'is')")
_search("search_regex", Query(name=r"-\d{2,3}\.(md|rs)$", regex_mode=True), f"{SHOWN} AND regexp_matches(name, '-[0-9]{{2,3}}\\.(md|rs)$', 'i')")
_search("search_or_pipe", Query(name="doc .zip|.mp3"), f"{SHOWN} AND contains(lower(name), 'doc') AND (contains(lower(name), '.zip') OR contains(lower(name), '.mp3'))")
_search("search_exclude", Query(name="*.rs !1 !2"), f"{SHOWN} AND lower(name) LIKE '%.rs' AND NOT contains(name, '1') AND NOT contains(name, '2')")
_search("search_phrase", Query(name='"Doc-1" !"ext:pdf"'), f"{SHOWN} AND contains(lower(name), 'doc-1')")
_search("search_full_path", Query(name="en/src1/ doc", full_path=True), f"{SHOWN} AND contains(lower(path), 'en/src1/') AND contains(lower(path), 'doc')")
_search("search_folder_token", Query(name="folder:src1? *.txt"), f"{SHOWN} AND regexp_matches(parent_name, '^src1.$', 'i') AND lower(name) LIKE '%.txt'")
_search("search_under", Query(name="doc", under="/corpus/en/src1/"), f"{SHOWN} AND contains(lower(name), 'doc') AND (path = '/corpus/en/src1' OR starts_with(path, '/corpus/en/src1/'))")
_search("search_in_token", Query(name="in:/corpus/de file:"), f"{SHOWN} AND NOT is_dir AND starts_with(path, '/corpus/de/')")
_search("filter_ext", Query(extensions=[" .PDF ", "gz", "pdf", ""]), f"{SHOWN} AND NOT is_dir AND ext IN ('pdf', 'gz')")
_search("filter_size", Query(name="size:1KB..2KB"), f"{SHOWN} AND NOT is_dir AND size BETWEEN 1024 AND 2048")
_search("filter_recent", Query(name="modified:2w"), f"{SHOWN} AND mtime >= {NOW - 1_209_600}")
_search("filter_hidden", Query(include_hidden=True, name=".doc"), "contains(lower(name), '.doc')")
_search("filter_files_only", Query(include_dirs=False), f"{SHOWN} AND NOT is_dir")
_search("search_limit", Query(name="doc", limit=25), f"{SHOWN} AND contains(lower(name), 'doc')", limited=True)
for _kind in _EXTS:
    _search(f"category_{_kind.lower()}", Query(category=Category(_kind)), f"{SHOWN} AND name_ext IN ({', '.join(repr(e) for e in _EXTS[_kind])})")
_search("category_recent", Query(category=Category("Recent", 604_800)), f"{SHOWN} AND mtime > 0 AND mtime >= {NOW - 604_800}")
_search("category_large", Query(category=Category("Large", 4096)), f"{SHOWN} AND NOT is_dir AND size >= 4096")
_search("search_fuzzy", Query(name="d1m", fuzzy=True), f"{SHOWN} AND regexp_matches(lower(name), 'd.*?1.*?m')")


@query(_sql("true", "id, path, name, dir, ext, name_ext, is_hidden, parent_name"))
def derive_columns(spark, sf_dir):
    return files(spark, sf_dir).select("id", "path", "name", "dir", "ext", "name_ext", "is_hidden", "parent_name")


@query(_sql(f"{SHOWN} AND contains(lower(name), 'doc-1')", "count(*)::BIGINT AS n"))
def count_query(spark, sf_dir):
    return search.count(files(spark, sf_dir), Query(name="doc-1", limit=3), now=NOW)


@query(_sql("true", "count_if(NOT is_dir)::BIGINT AS files, count_if(is_dir)::BIGINT AS dirs"))
def counts_files_dirs(spark, sf_dir):
    return search.counts(files(spark, sf_dir))


@query(
    _sql(
        f"{SHOWN} AND contains(lower(name), 'doc')",
        "count(*)::BIGINT AS \"all\", "
        f"count_if(mtime > 0 AND mtime >= {NOW - 604_800})::BIGINT AS recent, count_if(NOT is_dir AND size >= 4096)::BIGINT AS large, "
        + ", ".join(f"count_if(name_ext IN ({', '.join(repr(e) for e in v)}))::BIGINT AS {k.lower()}" for k, v in _EXTS.items())
        + ", count_if(path = '/corpus/en' OR starts_with(path, '/corpus/en/'))::BIGINT AS en, count_if(path = '/corpus/de/src1' OR starts_with(path, '/corpus/de/src1/'))::BIGINT AS de1",
    )
)
def facets(spark, sf_dir):
    return search.facets(files(spark, sf_dir), Query(name="doc"), NOW, large_bytes=4096, locations={"en": "/corpus/en", "de1": "/corpus/de/src1/"})


@query(
    f"{FILES_SQL} SELECT r.root, coalesce(count_if(NOT f.is_dir), 0)::BIGINT AS files, coalesce(count_if(f.is_dir), 0)::BIGINT AS dirs FROM (VALUES ('/corpus/en'), ('/corpus/fr/src2'), ('/none')) r(root) "
    "LEFT JOIN files f ON f.path = r.root OR starts_with(f.path, concat(r.root, '/')) GROUP BY r.root"
)
def root_counts(spark, sf_dir):
    return search.root_counts(files(spark, sf_dir), ["/corpus/en", "/corpus/fr/src2", "/none"])


@query(_sql(f"{SHOWN} AND NOT is_dir", tail="ORDER BY size DESC, length(name), path LIMIT 40"))
def sort_size_topk(spark, sf_dir):
    return search.ranked(files(spark, sf_dir), Query(include_dirs=False, limit=40), "size", now=NOW).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND contains(lower(name), 'doc-12')", "path, CASE WHEN lower(name) = 'doc-12' THEN 100 ELSE 80 - least(length(name) - 6, 19) END::INTEGER AS relevance, 1::INTEGER AS match", tail="ORDER BY 2 DESC, length(name), path LIMIT 30"))
def relevance_topk(spark, sf_dir):
    """A hit of the name that isn't a prefix of it cannot occur here but for hidden names, which are not shown."""
    return search.ranked(files(spark, sf_dir), Query(name="doc-12", limit=30), now=NOW).select("path", "relevance", "match")


FUZZY_SQL = f"""{FILES_SQL},
a AS (SELECT path, name, lower(name) AS h, instr(lower(name), 'd') AS p1 FROM files WHERE NOT is_hidden),
b AS (SELECT *, CASE WHEN instr(substr(h, (p1 + 1)::BIGINT), '1') > 0 THEN p1 + instr(substr(h, (p1 + 1)::BIGINT), '1') ELSE 0 END AS p2 FROM a WHERE p1 > 0),
c AS (SELECT *, CASE WHEN instr(substr(h, (p2 + 1)::BIGINT), 'm') > 0 THEN p2 + instr(substr(h, (p2 + 1)::BIGINT), 'm') ELSE 0 END AS p3 FROM b WHERE p2 > 0),
s AS (
  SELECT path, name, 48
    + CASE WHEN p1 = 1 OR substr(name, (p1 - 1)::BIGINT, 1) IN ('/', chr(92), '.', '_', '-', ' ', '(', '[', ',') THEN 8 ELSE 0 END
    + CASE WHEN substr(name, (p2 - 1)::BIGINT, 1) IN ('/', chr(92), '.', '_', '-', ' ', '(', '[', ',') THEN 8 ELSE 0 END
    + CASE WHEN substr(name, (p3 - 1)::BIGINT, 1) IN ('/', chr(92), '.', '_', '-', ' ', '(', '[', ',') THEN 8 ELSE 0 END
    + CASE WHEN p2 = p1 + 1 THEN 6 ELSE -least(p2 - p1 - 1, 12) END
    + CASE WHEN p3 = p2 + 1 THEN 6 ELSE -least(p3 - p2 - 1, 12) END
    - least(length(name) // 16, 16) AS score
  FROM c WHERE p3 > 0)
SELECT path, score::INTEGER AS score FROM s ORDER BY score DESC, length(name), path LIMIT 60"""


@query(FUZZY_SQL)
def fuzzy_rank_topk(spark, sf_dir):
    return search.ranked(files(spark, sf_dir), Query(name="d1m", fuzzy=True, limit=60), "fuzzy", now=NOW).select("path", "score")


def _lines(pattern: str, flags: str = "i") -> str:
    body = "CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END"
    return f"(length(text) > 0 AND len(list_filter(string_split({body}, chr(10)), lambda l: regexp_matches(l, '{pattern}', '{flags}'))) > 0)"


@query(_sql(f"{SHOWN} AND NOT is_dir AND {_lines('^the .*ing[.]')}"))
def content_line(spark, sf_dir):
    return search.content_matching(live(spark, sf_dir), None, Query(content="^the .*ing[.]"), NOW).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND NOT is_dir AND regexp_matches(text, '[.]{chr(92)}n[a-d]', 'i')"))
def content_multiline(spark, sf_dir):
    return search.content_matching(live(spark, sf_dir), None, Query(content=r"[.]\n[a-d]", multiline=True), NOW).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND NOT is_dir AND ext IN ('md', 'txt') AND contains(lower(name), 'doc') AND {_lines('license')}"))
def content_and_name(spark, sf_dir):
    """Candidates by name, then joined to their texts by path."""
    doc_text = corpus(spark, sf_dir).select("path", "text")
    return search.content_matching(files(spark, sf_dir), doc_text, Query(name="doc ext:md,txt", content="license"), NOW).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND NOT is_dir AND (contains(name, '77') OR {_lines('license')})", "path, CASE WHEN contains(name, '77') THEN 0 ELSE 1 END::INTEGER AS rank"))
def content_or_name(spark, sf_dir):
    return search.content_matching(live(spark, sf_dir), None, Query(name="77", content="license", content_or_name=True), NOW).select("path", "rank")


@query(_sql(f"{SHOWN} AND NOT is_dir AND {_lines('@mail[0-9]', '')}", "count(*)::BIGINT AS n"))
def count_content(spark, sf_dir):
    return search.count_content(live(spark, sf_dir), Query(content="@mail[0-9]", case_sensitive=True), now=NOW)


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with a zero byte behind the first 300 characters of each, as a binary file may have one."""
    rows = live(spark, sf_dir)
    return rows.withColumn("text", F.concat(F.substring("text", 1, 300), F.lit("\0"), F.expr("substring(text, 301)")))


@query(_sql(f"{SHOWN} AND NOT is_dir AND {_lines('^the .*ing[.]').replace('text', 'left(text, 300)')}"))
def content_binary_line(spark, sf_dir):
    """Content is matched up to the first zero byte."""
    return search.content_matching(binary(spark, sf_dir), None, Query(content="^the .*ing[.]"), NOW).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND NOT is_dir AND regexp_matches(left(text, 300), '[.]{chr(92)}n[a-d]', 'i')"))
def content_binary_multiline(spark, sf_dir):
    return search.content_matching(binary(spark, sf_dir), None, Query(content=r"[.]\n[a-d]", multiline=True), NOW).select(*search.RESULT)


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The documents' texts with their filters, stored like the catalog."""
    index = TextIndex(spark, f"{shared_dir(spark)}/texts-{zlib.crc32(sf_dir.encode()):08x}")
    return index.build(corpus(spark, sf_dir).select("path", "text"), stamp(spark, f"{sf_dir}/documents.parquet"))


@query(_sql(f"{SHOWN} AND NOT is_dir AND ext IN ('md', 'txt') AND contains(lower(name), 'doc') AND {_lines('license')}"))
def content_indexed(spark, sf_dir):
    """Candidates by name, joined to the texts of those files whose filter lets the pattern be there."""
    q = compile_query(Query(name="doc ext:md,txt", content="license"), NOW)
    return search.content_matching(files(spark, sf_dir), text_index(spark, sf_dir).texts(q), q).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND NOT is_dir AND {_lines('nderst.*ing')}"))
def content_indexed_rare(spark, sf_dir):
    """A pattern of which some letters are required, in any file."""
    q = compile_query(Query(content="nderst.*ing"), NOW)
    return search.content_matching(files(spark, sf_dir), text_index(spark, sf_dir).texts(q), q).select(*search.RESULT)


DUPLICATES_SQL = f"""{FILES_SQL} SELECT sha256(text) AS digest, size, count(*)::BIGINT AS n, ((count(*) - 1) * size)::BIGINT AS waste,
  arg_max(path, (mtime, path)) AS keep FROM files WHERE NOT is_dir AND size > 0 GROUP BY 1, 2 HAVING count(*) > 1"""


@query(DUPLICATES_SQL)
def duplicate_groups(spark, sf_dir):
    """Sizes come from the stored catalog; only texts of files that share their size with another are read."""
    return duplicates.duplicate_groups(duplicates.duplicate_members(files(spark, sf_dir), corpus(spark, sf_dir).select("path", "text")))


def written_files(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, DataFrame]:
    """The documents' texts as files of a shared folder, written by tasks, with a second name (a hard link) for every tenth; the folder, and (path, size, mtime, is_dir) of all names."""
    from urllib.parse import unquote, urlparse

    at = unquote(urlparse(workspace(spark, name, sf_dir)).path)

    def write(batches):
        import os

        os.makedirs(at, exist_ok=True)
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                body, path = (text or "").encode(), f"{at}/{doc_id}"
                part = f"{path}.{os.getpid()}"  # a task that runs again puts the same file in its place
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, path)
                names = [path]
                if doc_id % 10 == 0:
                    os.link(path, part)
                    os.replace(part, f"{path}.link")
                    names.append(f"{path}.link")
                out += [(n, len(body), EPOCH + int(doc_id) * 3600, False) for n in names]
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "is_dir"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return at, checkpointed(docs.mapInPandas(write, "path string, size long, mtime long, is_dir boolean"))


@query("SELECT sha256(text) AS digest, strlen(text)::BIGINT AS size, count(*)::BIGINT AS n, ((count(*) - 1) * strlen(text))::BIGINT AS waste, max(doc_id)::VARCHAR AS keep FROM documents WHERE strlen(text) > 0 GROUP BY text HAVING count(*) > 1")
def duplicate_files(spark, sf_dir):
    """Groups of equal files, read as files: by size, by their first 64 KiB, by all of them; names of one file count once."""
    _, listed = written_files(spark, sf_dir, "files")
    members, _ = duplicates.duplicate_files(listed)
    return duplicates.duplicate_groups(members).withColumn("keep", F.element_at(F.split("keep", "/"), -1))


@query(_sql("NOT is_dir AND sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)"))
def find_by_hash(spark, sf_dir):
    rows = live(spark, sf_dir)
    wanted = rows.filter("doc_id = 5").select(F.sha2("text", 256)).first()[0]
    return duplicates.find_by_hash(rows, wanted, "text").select(*search.RESULT)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a change stream on /u/<user>: purchases and sign-ups create, errors remove."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("/u/"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"),
        F.col("event_id").alias("size"),
        F.lit(EPOCH).cast("long").alias("mtime"),
        F.lit(False).alias("is_dir"),
        F.col("event_id").alias("seq"),
    )


CHANGES_SQL = "WITH changes AS (SELECT concat('/u/', (user_id % 7)::VARCHAR, '/', user_id::VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op, event_id AS size, event_id AS seq FROM events)"


@query(f"{CHANGES_SQL} SELECT path, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1")
def overlay_latest(spark, sf_dir):
    return overlay.latest(changes(spark, sf_dir)).select("path", "op", "seq")


SUBTREE_SQL = (
    CHANGES_SQL.replace("WITH changes", "WITH raw")
    + """, changes AS (SELECT * FROM raw UNION ALL SELECT '/u/3', 'remove', 0, (SELECT max(event_id) // 2 FROM events)),
base AS (SELECT concat('/u/', (k % 7)::VARCHAR, '/old-', k::VARCHAR) AS path, 1::BIGINT AS size, -1::BIGINT AS seq FROM range(70) t(k)),
live AS (SELECT path, size, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1 AND op = 'upsert' UNION ALL SELECT * FROM base)
SELECT path, size, seq FROM live l WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.op = 'remove' AND c.seq >= l.seq AND (c.path = l.path OR starts_with(l.path, concat(c.path, '/'))))"""
)


@query(SUBTREE_SQL)
def overlay_subtree_delete(spark, sf_dir):
    """A base of old files, the change stream, and the removal of one directory half-way through."""
    delta = changes(spark, sf_dir)
    half = delta.agg(F.floor(F.max("seq") / 2).cast("long").alias("seq"))
    gone = half.select(F.lit("/u/3").alias("path"), F.lit("remove").alias("op"), F.lit(0).cast("long").alias("size"), F.lit(EPOCH).cast("long").alias("mtime"), F.lit(True).alias("is_dir"), "seq")
    k = F.col("id")
    base = spark.range(70).select(F.concat(F.lit("/u/"), (k % 7).cast("string"), F.lit("/old-"), k.cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.lit(EPOCH).cast("long").alias("mtime"), F.lit(False).alias("is_dir"))
    return overlay.merge(base, delta.unionByName(gone)).select("path", "size", "seq")


@query(f"{CHANGES_SQL}, last AS (SELECT path, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1), base AS (SELECT DISTINCT path FROM changes WHERE op = 'upsert' AND size IN (SELECT event_id FROM events WHERE event_type = 'purchase')) SELECT path, op FROM last WHERE (op = 'upsert' AND path NOT IN (SELECT path FROM base)) OR (op = 'remove' AND path IN (SELECT path FROM base))")
def snapshot_prune(spark, sf_dir):
    delta = changes(spark, sf_dir)
    bought = read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"))
    base = delta.join(bought, "seq", "left_semi").select("path").distinct()
    return overlay.prune(delta, base).select("path", "op")


@query(f"{CHANGES_SQL} SELECT count(DISTINCT path)::BIGINT AS n FROM changes")
def delta_dirty(spark, sf_dir):
    return overlay.dirty(changes(spark, sf_dir))


@query(_sql("true", "path, row_number() OVER (ORDER BY path) AS row_id"))
def assign_ids(spark, sf_dir):
    return overlay.assign_ids(entries(spark, sf_dir)).select("path", F.col("id").alias("row_id"))


@query(_sql("NOT (path = '/corpus/en' OR starts_with(path, '/corpus/en/') OR path = '/corpus/de/src3' OR starts_with(path, '/corpus/de/src3/'))"))
def exclude_dirs(spark, sf_dir):
    return exclusions.not_excluded(files(spark, sf_dir), ["/corpus/en/", "/corpus/de/src3"]).select(*search.RESULT)


@query(_sql("NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT concat('/corpus/', d.lang, '/', d.source) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND l.quality = 0) e WHERE files.path = e.r OR starts_with(files.path, concat(e.r, '/')))"))
def exclude_table(spark, sf_dir):
    """Excluded paths from a table: an anti-join over ancestors."""
    bad = read(spark, sf_dir, "labels").filter("toxic = 1 AND quality = 0").select("doc_id")
    gone = read(spark, sf_dir, "documents").join(bad, "doc_id", "left_semi").select(F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source").alias("path")).distinct()
    return exclusions.excluded_by(files(spark, sf_dir), gone).select(*search.RESULT)


@query(_sql("starts_with(path, '/corpus/fr/') OR path IN ('/corpus/fr', '/corpus/es/src1') OR starts_with(path, '/corpus/es/src1/')"))
def roots_semi(spark, sf_dir):
    return exclusions.in_roots(files(spark, sf_dir), ["/corpus/fr", "/corpus/es/src1/"]).select(*search.RESULT)


@query(_sql("NOT regexp_matches(path, '/(src1|src2)(/|$)') AND NOT regexp_matches(path, '/fr/src3(/|$)')"))
def exclude_names(spark, sf_dir):
    return exclusions.pruned(files(spark, sf_dir), exclusions.ExcludeNames.parse("src1,src2/\n# note\nfr/src3")).select(*search.RESULT)


def tag_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as tags of documents, joined by id."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, " #good"), F.when(F.col("toxic") == 1, "##toxic"))).alias("tag")).filter("tag IS NOT NULL")
    return tags.cleaned(corpus(spark, sf_dir).select("doc_id", "path").join(labels, "doc_id").select("path", "tag"))


TAGS_SQL = f"{FILES_SQL}, tags AS (SELECT f.path, t.tag FROM files f JOIN (SELECT doc_id, 'good' AS tag FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) t ON f.doc_id = t.doc_id)"


@query(f"{TAGS_SQL} SELECT tag, count(*)::BIGINT AS n FROM tags GROUP BY tag")
def tags_histogram(spark, sf_dir):
    return tags.histogram(tag_relation(spark, sf_dir))


@query(f"{TAGS_SQL} SELECT path, size, mtime, is_dir FROM files WHERE path IN (SELECT path FROM tags WHERE tag = 'toxic')")
def tags_filter(spark, sf_dir):
    return tags.tagged(files(spark, sf_dir), tag_relation(spark, sf_dir), "#toxic ").select(*search.RESULT)


@query(f"{TAGS_SQL} SELECT f.path, coalesce(string_agg(t.tag, ',' ORDER BY t.tag), '') AS tags FROM files f LEFT JOIN tags t ON t.path = f.path GROUP BY f.path")
def tags_left_join(spark, sf_dir):
    return tags.with_tags(files(spark, sf_dir), tag_relation(spark, sf_dir)).select("path", F.array_join("tags", ",").alias("tags"))


@query(f"{TAGS_SQL} SELECT path, tag FROM tags WHERE path IN (SELECT path FROM files WHERE ext = 'md')")
def tags_prune(spark, sf_dir):
    return tags.prune_missing(tag_relation(spark, sf_dir), files(spark, sf_dir).filter("ext = 'md'"))


@query(_sql(f"{SHOWN} AND contains(lower(name), 'doc') AND contains(lower(path), 'de/src1')"))
def filter_within(spark, sf_dir):
    return search.within(search.matching(files(spark, sf_dir), Query(name="doc"), NOW).select(*search.RESULT), "DE/src1")


@query(f"{FILES_SQL}, wanted AS (SELECT path FROM files WHERE doc_id IN (SELECT doc_id FROM labels) UNION SELECT '/none/here') SELECT w.path, coalesce(f.size, 0)::BIGINT AS size, coalesce(f.mtime, 0)::BIGINT AS mtime, coalesce(f.is_dir, false) AS is_dir FROM wanted w LEFT JOIN files f USING (path)")
def point_lookup(spark, sf_dir):
    rows = files(spark, sf_dir)
    labelled = read(spark, sf_dir, "labels").select("doc_id")
    wanted = corpus(spark, sf_dir).select("doc_id", "path").join(labelled, "doc_id", "left_semi").select("path").union(spark.range(1).select(F.lit("/none/here").alias("path")))
    return search.lookup(rows, wanted)


EMPTY_SQL = f"""{FILES_SQL}, more AS (
  SELECT path, size, mtime, is_dir, dir FROM files
  UNION ALL SELECT concat('/corpus/', r_name), 0, {EPOCH}, true, '/corpus' FROM region
  UNION ALL SELECT concat('/corpus/', r_name, '/', n_name), n_nationkey % 3, {EPOCH}, false, concat('/corpus/', r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3)
SELECT path, size::BIGINT AS size, mtime::BIGINT AS mtime, is_dir FROM more WHERE (NOT is_dir AND size = 0) OR (is_dir AND path NOT IN (SELECT dir FROM more))"""


@query(EMPTY_SQL)
def empty_entries(spark, sf_dir):
    """The catalog with a directory for each region, which some nations are files of: every third of them is empty, and some regions have none."""
    regions, nations = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    stamp_ = F.lit(EPOCH).cast("long").alias("mtime")
    dirs = regions.select(F.concat(F.lit("/corpus/"), "r_name").alias("path"), F.lit(0).cast("long").alias("size"), stamp_, F.lit(True).alias("is_dir"))
    inside = nations.join(regions.filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    inside = inside.select(F.concat(F.lit("/corpus/"), "r_name", F.lit("/"), "n_name").alias("path"), (F.col("n_nationkey") % 3).cast("long").alias("size"), stamp_, F.lit(False).alias("is_dir"))
    rows = files(spark, sf_dir).select(*search.RESULT).unionByName(dirs).unionByName(inside)
    return search.empty_entries(paths.derive(rows))


@query(f"{FILES_SQL}, r AS (SELECT path, concat(dir, '/', replace(name, 'Doc-1', 'File-1')) AS new_path FROM files WHERE NOT is_dir AND contains(name, 'Doc-1')) SELECT path, new_path, (count(*) OVER (PARTITION BY new_path) > 1 OR new_path IN (SELECT path FROM files)) AS conflict FROM r")
def rename_preview(spark, sf_dir):
    rows = files(spark, sf_dir)
    return trash.rename_preview(rows.filter("NOT is_dir"), rows, "Doc-1", "File-1")


@query("SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages WHERE regexp_matches(html, 'utf-8') AND contains(url, '.example.org')")
def pages_as_files(spark, sf_dir):
    """pages as a second corpus: the path is the address without scheme and query, the content is the page."""
    pages = read(spark, sf_dir, "pages")
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    rows = paths.derive(pages.select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit(EPOCH).cast("long").alias("mtime"), F.lit(False).alias("is_dir"), F.col("html").alias("text")))
    return search.content_matching(rows.withColumn("id", F.col("page_id")), None, Query(name=".example.org", full_path=True, include_hidden=True, content="utf-8", case_sensitive=True), NOW).select("page_id", "path")


@query("SELECT conv_id, count(*)::BIGINT AS n FROM conversations WHERE regexp_matches(text, '^on', 'i') GROUP BY conv_id")
def conversation_lines(spark, sf_dir):
    """Conversations with turns that begin with a pattern."""
    from pathlake.plans.patterns import regex_term

    said = read(spark, sf_dir, "conversations").filter(regex_term(F.col("text"), "^on", False))
    return said.groupBy("conv_id").agg(F.count("*").alias("n"))


@query(_sql(f"{SHOWN} AND NOT is_dir AND ext = 'zip'", "path, concat('file://', path) AS uri"))
def copy_as_uri(spark, sf_dir):
    return search.matching(files(spark, sf_dir), Query(name="ext:zip"), NOW).select("path", codecs.file_uri(F.col("path")).alias("uri"))


def workspace(spark: SparkSession, name: str, sf_dir: str) -> str:
    """An empty folder in the shared one for a query over sf_dir; what the query's last run left there goes."""
    at = f"{shared_dir(spark)}/{name}-{zlib.crc32(sf_dir.encode()):08x}"
    delete(spark, at)
    return at


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of file-system events."""
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a streamed path must be a directory
    return e.select(
        F.concat(F.lit("/u/"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("path"),
        F.element_at(F.create_map(*[F.lit(x) for kv in (("signup", "create"), ("view", "metadata"), ("click", "data"), ("purchase", "rename_to"), ("error", "remove")) for x in kv]), F.col("event_type")).alias("kind"),
        F.col("event_id").alias("size"),
        F.lit(EPOCH).cast("long").alias("mtime"),
        F.lit(False).alias("is_dir"),
        F.col("event_id").alias("seq"),
    )


@query(f"{CHANGES_SQL} SELECT path, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1 AND op = 'upsert'")
def stream_cdc(spark, sf_dir):
    """The event stream ingested into a stored catalog, then its entries."""
    at = workspace(spark, "stream", sf_dir)
    catalog = Catalog(spark, f"{at}/catalog")
    cdc.ingest(event_stream(spark, sf_dir), catalog, f"{at}/offsets").awaitTermination()
    return catalog.entries().select("path", "size")


@query(f"{CHANGES_SQL} SELECT DISTINCT path FROM changes WHERE op = 'upsert' AND contains(string_split(path, '/')[-1], '1')")
def stream_watch_new(spark, sf_dir):
    """Each matching path once, as it appears."""
    at = workspace(spark, "watch", sf_dir)
    found = cdc.watch(event_stream(spark, sf_dir), Query(name="1"), NOW).select("path")
    found.writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/found")


def _zipped(batches):
    """(path, name_ext, content): each text as a zip file with two members."""
    for rows in batches:
        out = []
        for path, text in zip(rows["path"], rows["text"]):
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("text/body.txt", text or "")
                z.writestr("name.txt", path)
            out.append(b.getvalue())
        yield pd.DataFrame({"path": rows["path"], "name_ext": "zip", "content": out})


@query(_sql("NOT is_dir", "path, 'text/body.txt' AS member, size AS member_size") + f" UNION ALL SELECT path, 'name.txt', strlen(path)::BIGINT FROM files WHERE NOT is_dir")
def archive_members(spark, sf_dir):
    """Texts packed into zip files, and those files' listings."""
    packed = corpus(spark, sf_dir).select("path", "text").mapInPandas(_zipped, "path string, name_ext string, content binary")
    return archives.list_members(packed).select("path", "member", F.col("size").alias("member_size"))


def _docx(batches):
    """(path, ext, content): each text as a DOCX file, a paragraph a line."""
    for rows in batches:
        out = []
        for text in rows["text"]:
            lines = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in (text or "").split("\n"))
            b = io.BytesIO()
            with zipfile.ZipFile(b, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{lines}</w:body></w:document>')
            out.append(b.getvalue())
        yield pd.DataFrame({"path": rows["path"], "ext": "docx", "content": out})


@query(_sql("NOT is_dir", "path, sha256(concat(text, chr(10))) AS digest"))
def extract_docx(spark, sf_dir):
    """Texts packed into DOCX files, and extracted again."""
    packed = corpus(spark, sf_dir).select("path", "text").mapInPandas(_docx, "path string, ext string, content binary")
    return packed.select("path", F.sha2(documents.extract_text("ext", "content"), 256).alias("digest"))


@query(_sql("NOT is_dir AND ext != 'zip'", "concat(id::VARCHAR, '.gone') AS name, path AS original_path, concat('2024-01-', lpad((length(path) % 28 + 1)::VARCHAR, 2, '0'), 'T00:00:00') AS deletion_date"))
def trash_list(spark, sf_dir):
    """Info records made of all paths, parsed, held against the payloads that are there."""
    rows = files(spark, sf_dir).filter("NOT is_dir")
    name = F.concat(F.col("id").cast("string"), F.lit(".gone"))
    day = F.lpad((F.char_length("path") % 28 + 1).cast("string"), 2, "0")
    record = F.concat(F.lit("[Trash Info]\nPath="), codecs.encode_path_column(F.col("path")), F.lit("\nDeletionDate=2024-01-"), day, F.lit("T00:00:00\n"))
    info = trash.parse_info(rows.select(F.concat(F.lit("/trash/info/"), name, F.lit(".trashinfo")).alias("file"), record.alias("value")))
    return trash.listing(info, rows.filter("ext != 'zip'").select(name.alias("name")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, target): source files as links to the Markdown file of the next document but eight, which often isn't there."""
    rows = corpus(spark, sf_dir).filter("doc_id % 10 = 3")
    target = F.concat(F.regexp_replace("path", "/[^/]*$", "/Doc-"), (F.col("doc_id") + 8).cast("string"), F.lit(".md"))
    return rows.select("path", target.alias("target"))


@query(f"{FILES_SQL}, links AS (SELECT path, concat(dir, '/Doc-', (doc_id + 8)::VARCHAR, '.md') AS target FROM files WHERE NOT is_dir AND doc_id % 10 = 3) SELECT path, target FROM links WHERE target NOT IN (SELECT path FROM files)")
def broken_links(spark, sf_dir):
    return search.broken_links(links(spark, sf_dir), files(spark, sf_dir))


@query(f"{FILES_SQL}, pool AS (SELECT * FROM files WHERE {SHOWN} AND NOT is_dir AND contains(lower(name), 'doc') ORDER BY id LIMIT 200) SELECT path FROM pool WHERE {_lines('license')} ORDER BY id LIMIT 40")
def content_candidate_cap(spark, sf_dir):
    """As the interactive engine: of the first 200 candidates those with the pattern, at most 40."""
    doc_text = corpus(spark, sf_dir).select("path", "text")
    return search.search(files(spark, sf_dir), Query(name="doc", content="license", limit=40), doc_text, NOW, candidate_cap=200).select("path")


@query(_sql("NOT is_dir", "path, CASE ext WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'zip' THEN 'application/zip' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'mp4' THEN 'video/mp4' WHEN 'gz' THEN 'application/gzip' ELSE 'application/octet-stream' END AS mime, sha256(text) AS sha256, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS modified"))
def details(spark, sf_dir):
    """The details of every file: MIME type, digest of the content, time."""
    return search.details(live(spark, sf_dir))


@query(_sql("NOT is_dir", "path, CASE WHEN size <= 1000 THEN sha256(text) END AS sha256"))
def details_bounded(spark, sf_dir):
    """Digests on demand of files up to a size; of larger ones none."""
    return search.details(live(spark, sf_dir), largest=1000).select("path", "sha256")


@query(_sql("NOT is_dir AND NOT is_hidden AND contains(lower(name), 'doc')", "path, concat('user', (doc_id % 5)::VARCHAR) AS owner", "ORDER BY doc_id % 11 DESC, length(name), path LIMIT 60"))
def sort_created_topk(spark, sf_dir):
    """The newest by creation time, of a catalog that keeps what a walk with details found."""
    catalog = Catalog(spark, f"{workspace(spark, 'details', sf_dir)}/catalog")
    owner = F.concat(F.lit("user"), (F.col("doc_id") % 5).cast("string"))
    listed = corpus(spark, sf_dir).select("path", "size", "mtime", "is_dir", (F.col("doc_id") % 11).alias("created"), owner.alias("owner"))
    catalog.rebuild(listed)
    return search.ranked(catalog.detailed(), Query(name="doc", limit=60), "created", now=NOW).select("path", "owner")


@query(f"{CHANGES_SQL}, last AS (SELECT path, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1), half AS (SELECT path, max(seq) AS done FROM changes WHERE op = 'upsert' AND seq < (SELECT max(event_id) * 49 // 50 FROM events) GROUP BY path) SELECT l.path, l.seq FROM last l LEFT JOIN half h ON h.path = l.path WHERE l.op = 'upsert' AND (h.done IS NULL OR h.done < l.seq)")
def texts_pending(spark, sf_dir):
    """What an extraction that has not come to the last changes is behind by."""
    catalog = Catalog(spark, f"{workspace(spark, 'pending', sf_dir)}/catalog")
    catalog.rebuild(changes(spark, sf_dir).limit(0))
    catalog.apply(changes(spark, sf_dir))
    late = read(spark, sf_dir, "events").agg(F.floor(F.max("event_id") * 49 / 50)).first()[0] or 0
    done = changes(spark, sf_dir).filter((F.col("op") == "upsert") & (F.col("seq") < late)).groupBy("path").agg(F.max("seq").alias("seq"))
    catalog.add_texts(done.withColumn("text", F.lit("x")))
    return catalog.pending_texts()


@query(f"{FILES_SQL}, spelled AS (SELECT path, hex(path::BLOB) AS h FROM files) SELECT path, format('{{:016x}}', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS hash FROM spelled")
def path_hashes(spark, sf_dir):
    """The hash of every path, byte by byte."""
    return files(spark, sf_dir).select("path", codecs.path_hash(F.col("path")).alias("hash"))


MOVED_SQL = f"{FILES_SQL}, new AS (SELECT path, CASE WHEN doc_id % 5 = 1 THEN size + 1 ELSE size END AS size, mtime, is_dir FROM files WHERE doc_id % 7 != 2 UNION ALL SELECT concat(path, '.new'), size, mtime, is_dir FROM files WHERE NOT is_dir AND doc_id % 11 = 0)"


def walked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing as a later walk might find it: some files gone, some grown, some new. Directories have the numbers that their files give them."""
    docs = corpus(spark, sf_dir).select("doc_id", "path", "size", "mtime", "is_dir")
    dirs = docs.groupBy(paths.dir_of(F.col("path")).alias("path")).agg((-1 - F.min("doc_id")).alias("doc_id"))
    rows = docs.unionByName(dirs.select("doc_id", "path", F.lit(0).cast("long").alias("size"), F.lit(EPOCH).cast("long").alias("mtime"), F.lit(True).alias("is_dir")))
    left = rows.filter("doc_id % 7 != 2").withColumn("size", F.when(F.col("doc_id") % 5 == 1, F.col("size") + 1).otherwise(F.col("size")))
    new = docs.filter("doc_id % 11 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    return left.unionByName(new).drop("doc_id")


@query(f"{MOVED_SQL} SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'remove' ELSE 'upsert' END AS op, n.size AS size FROM files o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size != n.size")
def rescan_changes(spark, sf_dir):
    """What a rescan applies: the stored catalog against a later walk."""
    return walk.changes(files(spark, sf_dir).select(*search.RESULT), walked_again(spark, sf_dir), 1).select("path", "op", "size")


@query(f"{MOVED_SQL} SELECT count_if(NOT is_dir)::BIGINT AS files, count_if(is_dir)::BIGINT AS dirs FROM new")
def counts_with_changes(spark, sf_dir):
    """Counts after a rescan, from the base's counts and its changes alone."""
    base = files(spark, sf_dir).select(*search.RESULT)
    return overlay.counts_with(base, walk.changes(base, walked_again(spark, sf_dir), 1))


def rescanned(spark: SparkSession, sf_dir: str, name: str) -> Catalog:
    """A catalog of the documents after a rescan that found the later walk: a snapshot, and changes that have one number."""
    catalog = Catalog(spark, f"{workspace(spark, name, sf_dir)}/catalog")
    catalog.rebuild(entries(spark, sf_dir))
    catalog.apply(walk.changes(catalog.entries(), walked_again(spark, sf_dir), catalog.next_seq()))
    return catalog


LIVE_SQL = f"""{MOVED_SQL}, changed AS (
  SELECT coalesce(n.path, o.path) AS path, row_number() OVER (ORDER BY coalesce(n.path, o.path)) AS place FROM files o FULL JOIN new n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size != n.size
), live AS (
  SELECT n.*, coalesce(o.id, (SELECT count(*) FROM files) + c.place)::BIGINT AS row_id, lower(string_split(n.path, '/')[-1]) AS lower_name,
         CASE WHEN n.is_dir THEN '' ELSE lower(regexp_extract(string_split(n.path, '/')[-1], '^.+\\.([^.]*)$', 1)) END AS ext, regexp_matches(n.path, '(^|/)\\.[^/]') AS is_hidden
  FROM new n LEFT JOIN files o ON o.path = n.path LEFT JOIN changed c ON c.path = n.path
)"""


@query(f"{LIVE_SQL} SELECT path, size, row_id FROM live")
def live_ids(spark, sf_dir):
    """Every row after a rescan with its id: what was there keeps it, what is new comes after, in order of paths."""
    return rescanned(spark, sf_dir, "live-ids").files().select("path", "size", F.col("id").alias("row_id"))


@query(f"{LIVE_SQL} SELECT path, size, row_id FROM live WHERE contains(lower_name, '7') AND NOT is_hidden ORDER BY row_id LIMIT 150")
def search_limit_live(spark, sf_dir):
    """The first rows of a catalog with changes, which hold some that the rescan brought where the documents are few. Files are read until the limit is met."""
    return rescanned(spark, sf_dir, "live-limit").search(Query(name="7", limit=150), NOW, ("path", "size", "id")).withColumnRenamed("id", "row_id")


WATCH_SQL = f"""{LIVE_SQL}, first AS (
  SELECT path, size FROM files WHERE contains(lower(name), 'doc-1') AND NOT is_hidden ORDER BY id LIMIT 40
), second AS (
  SELECT path, size FROM live WHERE contains(lower_name, 'doc-1') AND NOT is_hidden ORDER BY row_id LIMIT 40
)"""


@query(f"{WATCH_SQL} SELECT 0::BIGINT AS poll, path, size FROM first UNION ALL SELECT 2, path, size FROM second WHERE path NOT IN (SELECT path FROM first)")
def watch_polls(spark, sf_dir):
    """Four polls of a watch over a catalog that a rescan changes after the second, each by an engine of its own, as after a restart."""
    at = workspace(spark, "watch-polls", sf_dir)
    catalog = Catalog(spark, f"{at}/catalog")
    catalog.rebuild(entries(spark, sf_dir))
    for number in range(4):
        if number == 2:
            catalog.apply(walk.changes(catalog.entries(), walked_again(spark, sf_dir), catalog.next_seq()))
        Engine(spark, f"{at}/catalog").poll(Query(name="doc-1", limit=40), number, f"{at}/seen", NOW)
    return Engine(spark, f"{at}/catalog").reported(f"{at}/seen").select("poll", "path", "size")


@query(f"{CHANGES_SQL} SELECT path, op, size, seq FROM changes")
def pushed_frames(spark, sf_dir):
    """The event stream's changes, pushed as lines of JSON and read by a client."""
    at = workspace(spark, "frames", sf_dir)
    frames.push(cdc.normalise(event_stream(spark, sf_dir)), f"{at}/lines", f"{at}/offsets").awaitTermination()
    row = F.from_json("line", "path string, op string, size long, seq long").alias("r")
    return frames.pushed(spark, f"{at}/lines").select(row).select("r.*")


@query(f"{LIVE_SQL} SELECT path, size, row_id FROM live WHERE contains(lower_name, '.new') AND size >= 100 AND NOT is_hidden ORDER BY row_id LIMIT 100")
def search_limit_new(spark, sf_dir):
    """The first rows among those that only the changes have."""
    return rescanned(spark, sf_dir, "live-new").search(Query(name=".new size:>=100", limit=100), NOW, ("path", "size", "id")).withColumnRenamed("id", "row_id")


@query(f"{LIVE_SQL} SELECT path, size, row_id FROM live")
def compaction_keeps_ids(spark, sf_dir):
    """The same after a compaction."""
    catalog = rescanned(spark, sf_dir, "live-compact")
    if not catalog.compact(0):
        raise RuntimeError("nothing to compact")
    return catalog.snapshot().select("path", "size", F.col("id").alias("row_id"))


@query(f"{LIVE_SQL} SELECT count(*)::BIGINT AS \"all\", count_if(mtime > 0 AND mtime >= {NOW - 604_800})::BIGINT AS recent, count_if(NOT is_dir AND size >= 104857600)::BIGINT AS large, " + ", ".join(f"count_if(lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)) IN ({', '.join(repr(e) for e in exts)}))::BIGINT AS {k.lower()}" for k, exts in _EXTS.items()) + " FROM live")
def facets_from_record(spark, sf_dir):
    """All facets after a rescan: the record's counts, corrected by the changes, and a scan of recent rows alone."""
    return rescanned(spark, sf_dir, "live-facets").facets(Query(), NOW)


@query(f"{CHANGES_SQL} SELECT path, concat('text of ', path) AS text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1 AND op = 'upsert'")
def stream_extract(spark, sf_dir):
    """Two streams over the same events: one keeps the catalog, one the texts; then the texts of what is still there."""
    at = workspace(spark, "extract", sf_dir)
    catalog = Catalog(spark, f"{at}/catalog")
    cdc.ingest(event_stream(spark, sf_dir), catalog, f"{at}/offsets").awaitTermination()
    read_text = lambda wanted: wanted.select("path", F.concat(F.lit("text of "), "path").alias("text"))
    cdc.extract_stream(cdc.normalise(event_stream(spark, sf_dir)), catalog, read_text, f"{at}/texts-offsets").awaitTermination()
    return catalog.texts()


@query(f"{CHANGES_SQL} SELECT path, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) JOIN documents ON string_split(path, '/')[-1] = doc_id::VARCHAR WHERE r = 1 AND op = 'upsert' AND text IS NOT NULL")
def stream_extract_documents(spark, sf_dir):
    """Two streams over the same events: one keeps the catalog, one reads the texts of what changes (a user's file is the document of that number); then the texts of
    what is still there."""
    at = workspace(spark, "extract-documents", sf_dir)
    catalog = Catalog(spark, f"{at}/catalog")
    cdc.ingest(event_stream(spark, sf_dir), catalog, f"{at}/offsets").awaitTermination()
    stored_texts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text").filter("text IS NOT NULL")

    def read_text(wanted):
        return wanted.withColumn("name", paths.name_of(F.col("path"))).join(stored_texts, "name").select("path", "text")

    cdc.extract_stream(cdc.normalise(event_stream(spark, sf_dir)), catalog, read_text, f"{at}/texts-offsets").awaitTermination()
    return catalog.texts()


@query(_sql(f"{SHOWN} AND NOT is_dir AND ext IN ('md', 'pdf') AND size >= 1025 AND starts_with(path, '/corpus/en/')"))
def coarse_candidates(spark, sf_dir):
    """What is left of a query without its names: the part that Parquet statistics prune by."""
    q = compile_query(Query(name="no-such-name ext:md,pdf size:>1KB file:", under="/corpus/en"), NOW)
    return files(spark, sf_dir).filter(q.coarse(files_only=False)).select(*search.RESULT)


@query(_sql(f"{SHOWN} AND contains(lower(name), 'doc-3')", "name, path, size::VARCHAR AS size, mtime::VARCHAR AS modified"))
def export_tsv(spark, sf_dir):
    """A result list written as TSV, and read again."""
    at = workspace(spark, "export", sf_dir)
    export.export(search.matching(files(spark, sf_dir), Query(name="doc-3"), NOW), f"{at}/tsv", "tsv")
    return spark.read.csv(f"{at}/tsv", sep="\t", header=True)


@query(_sql("NOT is_dir", "count(*)::BIGINT AS entries, sum(strlen(text))::BIGINT AS bytes"))
def text_cache_stats(spark, sf_dir):
    """All texts put into a catalog's cache, as two batches of which the later counts."""
    catalog = Catalog(spark, f"{workspace(spark, 'cache', sf_dir)}/catalog")
    catalog.rebuild(entries(spark, sf_dir))
    texts = corpus(spark, sf_dir).select("path", "text")
    catalog.add_texts(texts.withColumn("text", F.lit("old")), 1)
    catalog.add_texts(texts, 2)
    return catalog.text_stats()


@query(f"{FILES_SQL}, run AS (SELECT path, sum(strlen(text)) OVER (ORDER BY doc_id DESC) AS so_far FROM files WHERE NOT is_dir) SELECT path FROM run WHERE so_far <= 200000")
def text_cache_eviction(spark, sf_dir):
    """The newest texts that fit in 200 kB together: the oldest go first."""
    cached = corpus(spark, sf_dir).select("path", "text", F.col("doc_id").alias("seq"))
    return documents.within_cap(cached, 200_000).select("path")


@query(f"{FILES_SQL}, run AS (SELECT path, sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id % 3 DESC, path) AS so_far, sum(strlen(coalesce(text, ''))) OVER () AS whole FROM files WHERE NOT is_dir) SELECT path FROM run WHERE so_far <= whole // 2")
def text_cache_eviction_ties(spark, sf_dir):
    """Texts of three numbers only, as whole directories are extracted under one: half of all bytes stay, the cut being inside a number."""
    cached = corpus(spark, sf_dir).select("path", "text", (F.col("doc_id") % 3).alias("seq"))
    half = cached.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return documents.within_cap(cached, half // 2).select("path")


@query(f"{CHANGES_SQL}, last AS (SELECT path, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM changes) WHERE r = 1 AND op = 'upsert') SELECT path, size, row_number() OVER (ORDER BY path) AS row_id FROM last")
def compacted_catalog(spark, sf_dir):
    """All changes applied to an empty catalog, and a rebuild once they are over the threshold: ids follow paths again."""
    catalog = Catalog(spark, f"{workspace(spark, 'compact', sf_dir)}/catalog")
    catalog.rebuild(changes(spark, sf_dir).limit(0))
    catalog.apply(changes(spark, sf_dir))
    if not catalog.compact(threshold=1, renumber=True):
        raise RuntimeError("nothing to compact")
    return catalog.snapshot().select("path", "size", F.col("id").alias("row_id"))


MOUNTS_SQL = f"""WITH base AS (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
mounts AS (SELECT concat('/dev/sd', chr((97 + k % 4)::INTEGER), (k % 3)::VARCHAR) AS device, concat(CASE k % 4 WHEN 0 THEN '/media/u/' WHEN 1 THEN '/mnt/' WHEN 2 THEN '/data/' ELSE '/run/media/u/' END, replace(r_name, ' ', ''), ' ', n_name) AS point,
  CASE k % 5 WHEN 0 THEN 'ext4' WHEN 1 THEN 'nfs4' WHEN 2 THEN 'proc' WHEN 3 THEN 'vfat' ELSE 'btrfs' END AS fstype FROM base)"""


def mount_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a mount table, written with octal escapes for spaces and read again."""
    base = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (k % len(x) + 1).cast("int"))
    point = F.concat(pick("/media/u/", "/mnt/", "/data/", "/run/media/u/"), F.replace("r_name", F.lit(" "), F.lit("")), F.lit(" "), "n_name")
    line = F.concat_ws(" ", F.concat(F.lit("/dev/sd"), pick("a", "b", "c", "d"), (k % 3).cast("string")), F.replace(point, F.lit(" "), F.lit("\\040")), pick("ext4", "nfs4", "proc", "vfat", "btrfs"), F.lit("rw 0 0"))
    at = f"{workspace(spark, 'mounts', sf_dir)}/table"
    base.select(line.alias("value")).write.text(at)
    return mounts.read_mounts(spark, at)


@query(f"{MOUNTS_SQL} SELECT * FROM mounts")
def mounts_read(spark, sf_dir):
    return mount_table(spark, sf_dir)


@query(f"{MOUNTS_SQL} SELECT point FROM mounts WHERE (fstype IN ('proc', 'nfs4', 'btrfs') OR starts_with(point, '/media/') OR starts_with(point, '/run/media/')) AND NOT starts_with(point, '/data/ASIA ') AND point != '/data/ASIA'")
def mounts_left_out(spark, sf_dir):
    """Pseudo, network, removable and one more kind of file systems; none that holds a root."""
    table = mount_table(spark, sf_dir)
    roots = [r["point"] + "/home" for r in table.filter("point LIKE '/data/ASIA %'").select("point").collect()]  # a mount table is short
    return exclusions.mounts_excluded(table, roots, ("btrfs",)).select("point")


@query(f"{MOUNTS_SQL} SELECT device, point FROM mounts WHERE fstype != 'nfs4' AND regexp_matches(device, '^/dev/sd[bd]') AND regexp_matches(point, '^(/media|/run/media|/mnt)/')")
def mounts_removable(spark, sf_dir):
    return mounts.removable_mounts(mount_table(spark, sf_dir), ["sdb", "sdd"]).select("device", "point")


@query(f"{TAGS_SQL} SELECT path, tag FROM tags WHERE tag != 'toxic' OR path NOT IN (SELECT path FROM files WHERE ext = 'pdf') UNION SELECT path, 'picture' FROM files WHERE ext = 'png'")
def tags_edit(spark, sf_dir):
    """One tag added to all pictures and one taken from all PDF files."""
    rows = files(spark, sf_dir)
    added = tags.add(tag_relation(spark, sf_dir), rows.filter("ext = 'png'"), "#picture")
    return tags.remove(added, rows.filter("ext = 'pdf'"), "toxic")


@query(f"{TAGS_SQL} SELECT path, tag FROM tags")
def tags_document(spark, sf_dir):
    """The relation as its document, and the document as a relation."""
    at = f"{workspace(spark, 'tags', sf_dir)}/document"
    spark.createDataFrame([(tags.to_json(tag_relation(spark, sf_dir)),)], "value string").coalesce(1).write.text(at)
    return tags.load(spark, at)


def _packed(kind):
    """(path, ext, content): each path as the text of a file of a kind."""
    import tarfile

    def pack(path):
        b = io.BytesIO()
        if kind == "odt":
            with zipfile.ZipFile(b, "w") as z:
                z.writestr("content.xml", f'<o xmlns:text="t"><text:p>{escape(path)}</text:p></o>')
        elif kind == "tar":
            with tarfile.open(fileobj=b, mode="w") as t:
                info = tarfile.TarInfo(path.strip("/"))
                info.size = len(path.encode())
                t.addfile(info, io.BytesIO(path.encode()))
        elif kind == "pdf":
            shown = "FEFF" + path.encode("utf-16-be").hex()
            body = zlib.compress(f"BT /F1 9 Tf <{shown}> Tj ET".encode())
            return b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n"
        else:
            return path.encode()
        return b.getvalue()

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"path": rows["path"], "ext": kind, "content": [pack(p) for p in rows["path"]]})

    return run


def _extracted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    packed = files(spark, sf_dir).filter("NOT is_dir").select("path").mapInPandas(_packed(kind), "path string, ext string, content binary")
    return packed.select("path", documents.extract_text("ext", "content").alias("text"))


@query(_sql("NOT is_dir", "path, concat(path, chr(10)) AS text"))
def extract_odt(spark, sf_dir):
    return _extracted(spark, sf_dir, "odt")


@query(_sql("NOT is_dir", "path, path AS text"))
def extract_pdf(spark, sf_dir):
    return _extracted(spark, sf_dir, "pdf")


@query(_sql("NOT is_dir", "path, path AS text"))
def extract_plain(spark, sf_dir):
    return _extracted(spark, sf_dir, "txt")


@query(_sql("NOT is_dir", "path, ltrim(path, '/') AS member, path AS text"))
def archive_texts_tar(spark, sf_dir):
    """Members of tar files with their texts."""
    packed = files(spark, sf_dir).filter("NOT is_dir").select("path").mapInPandas(_packed("tar"), "path string, ext string, content binary")
    return archives.member_texts(packed.withColumnRenamed("ext", "name_ext")).select("path", "member", "text")


@query(_sql("true", "count_if(NOT is_dir)::BIGINT AS files, count_if(is_dir)::BIGINT AS dirs, 0::BIGINT AS dirty"))
def catalog_status(spark, sf_dir):
    s = stored(spark, sf_dir).status()
    return spark.createDataFrame([(s["files"], s["dirs"], s["dirty"])], "files long, dirs long, dirty long")


@query(_sql(f"{SHOWN} AND contains(lower(name), 'doc-1')", f"path, size, (SELECT count(*) >= 20 FROM files WHERE {SHOWN} AND contains(lower(name), 'doc-1')) AS truncated, (SELECT count_if(NOT is_dir) FROM files)::BIGINT AS indexed", "ORDER BY id LIMIT 20"))
def search_envelope(spark, sf_dir):
    """A search's rows, each with what it says of itself: whether there may be more, and how many files there are."""
    r = search.run(files(spark, sf_dir), Query(name="doc-1", limit=20), now=NOW)
    return r.results.select("path", "size", F.lit(r.truncated).alias("truncated"), F.lit(r.indexed).cast("long").alias("indexed"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_flagship"](spark, sf_dir)
