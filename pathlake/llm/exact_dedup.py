"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows are digested, reduced to one row a digest, held against the index by a sort-merge anti-join,
and what is new is appended. The index lies in the shared folder and stays between jobs and sessions. What each batch adds is a generation, a table of its own with
one sorted file a bucket: joins read generations one after the other, each without a shuffle or a sort, and only the new batch is sorted. A generation with
over a MERGE-th of the rows of the one before is merged with it, so there are few, and a row is written again a logarithm of times.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathlake.llm.common import BROADCAST_ROWS, checkpointed, fresh_name, lookup
from pathlake.sources.shared import delete, listing, shared_dir, subfolders

#: A generation stays by itself while the one before has more than so many times its rows.
MERGE = 4
#: The white space that doesn't count: code points 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"


def digest(text: str) -> Column:
    """SHA-256 of a text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES, ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n, text_sha256) of every row: code points of the text and digest of the text without white space. Ids keep their type."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("n"),
        digest(text_col).alias("text_sha256"),
    )


class DigestIndex:
    """The digests of all that was ever added, as tables `name`, `name`_g1 and so on (text_sha256, keep_id, n_rows, batch) in a folder of the shared store.

    add(docs) returns one row per document, dropped ones too:
    doc_id, keep_id, group_size, kept, text_sha256.

    * Null text counts as empty; empty texts are equal to each other and to texts of white space alone.
    * Of equal texts in one batch the one with the most code points stays, then the smallest doc_id, then
      (repeated rows) any one of them: exactly one row of a group is kept. A null doc_id loses every tie.
    * Texts that an earlier batch holds are dropped; keep_id is then that batch's. group_size counts the rows
      of this batch and those of the batch that held the text first.
    * A batch may be added again, as by a job that is run again after it failed: the answer is the same and the index does not grow.
      Batches are told apart by the name that add() is given or, without one, by a hash of their digests and ids.
    * An empty table gives no rows. Other columns are not read, so their names cannot clash. Ids may be of any type that has an order.

    A session without the table attaches the folder's files. The number of buckets is that of the files that are there; it only counts for a new index.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, folder: str | None = None):
        self.spark, self.name = spark, name
        self.folder = folder or f"{shared_dir(spark)}/{name}"
        there = [x for x in subfolders(spark, self.folder) if x.startswith("buckets-")]
        self.buckets = int(there[0].split("-")[1]) if there else buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # a bucket of a generation is one sorted file, which this lets the planner rely on
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _generations(self) -> dict[int, str]:
        """The folders of the generations that count, by number: those that were written whole and that no merged one stands for."""
        found, gone = {}, set()
        for x in subfolders(self.spark, self.folder):
            if m := re.fullmatch(r"buckets-[0-9]+(?:-g([0-9]+)(?:-from([0-9]+))?)?", x):
                k = int(m[1] or 0)
                if k == 0 or any(n == "_SUCCESS" for n, _ in listing(self.spark, f"{self.folder}/{x}")):
                    found[k] = x
                    gone |= set(range(int(m[2]), k)) if m[2] else set()
        found = found or {0: f"buckets-{self.buckets}"}  # before its first row
        return {k: x for k, x in sorted(found.items()) if k not in gone}

    def _table_name(self, k: int) -> str:
        return f"{self.name}_g{k}" if k else self.name

    def tables(self) -> list[DataFrame]:
        """The generations, each without a sort or shuffle by digest."""
        out = []
        for k, folder in self._generations().items():
            if k:
                ids = self.spark.read.parquet(f"{self.folder}/{folder}").schema["keep_id"].dataType.simpleString()
                self._create(ids, k, folder)
            out.append(self.spark.table(self._table_name(k)))
        return out

    def table(self) -> DataFrame:
        """All that the index holds."""
        return reduce(DataFrame.unionByName, self.tables())

    def drop(self) -> DigestIndex:
        """Removes the tables and their files."""
        for t in self.spark.catalog.listTables(pattern=f"{self.name.lower()}*"):
            if re.fullmatch(rf"{re.escape(self.name.lower())}(_g[0-9]+)?", t.name.lower()):
                self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")
        delete(self.spark, self.folder)
        return self

    def _create(self, id_type: str, k: int = 0, folder: str | None = None) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table_name(k)} (text_sha256 STRING, keep_id {id_type}, n_rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{folder or f'buckets-{self.buckets}'}'"
        )

    def _append(self, rows: DataFrame, stands_from: int | None = None) -> None:
        """A generation of rows, one file a bucket, as a task writes one bucket; one that stands for all from a number on counts once it is whole."""
        there = self._generations()
        k = max(there) + 1
        if there == {0: f"buckets-{self.buckets}"} and not listing(self.spark, f"{self.folder}/{there[0]}"):
            k = 0
        folder = f"buckets-{self.buckets}" + (f"-g{k}" if k else "") + (f"-from{stands_from}" if stands_from is not None else "")
        if k:  # what a job that died left of it
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(k)}")
            for old in subfolders(self.spark, self.folder):
                if re.fullmatch(rf"buckets-[0-9]+-g{k}(-from[0-9]+)?", old):
                    delete(self.spark, f"{self.folder}/{old}")
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.mode("append")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .format("parquet")
            .option("path", f"{self.folder}/{folder}")
            .saveAsTable(self._table_name(k))
        )

    def _merge(self) -> None:
        """One generation in place of the last ones, as far back as each is not much larger than what follows."""
        old = self._generations()
        tables, numbers = self.tables(), list(old)
        rows, first = tables[-1].count(), len(tables) - 1
        while first and rows * MERGE >= (n := tables[first - 1].count()):
            rows, first = rows + n, first - 1
        if first == len(tables) - 1:
            return
        self._append(checkpointed(reduce(DataFrame.unionByName, tables[first:])), stands_from=numbers[first])
        for k in numbers[first:]:
            if k:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(k)}")
            delete(self.spark, f"{self.folder}/{old[k]}")

    def unseen(self, best: DataFrame) -> DataFrame:
        """The rows of best (text_sha256, ...) that no generation has."""
        for t in self.tables():
            best = best.join(t.select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        return best

    def resolve(self, docs: DataFrame, id_col: str, text_col: str, batch: str | None) -> DataFrame:
        """(doc_id, row, text_sha256, keep_id, group_size, here, kept) of every row; here: this batch is the first with its text."""
        # digested once; what follows reads small rows
        rows = checkpointed(digests(docs, id_col, text_col))
        # one row a digest before anything is shuffled: a text with a third of all rows is one row a task here
        order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "row")
        best = rows.groupBy("text_sha256").agg(F.min(order).alias("b"), F.count("*").alias("n_here"))
        best = checkpointed(best.select("text_sha256", F.col("b.doc_id").alias("id_here"), F.col("b.row").alias("keep_row"), "n_here"))
        said = best.agg(F.count("*").alias("digests"), F.coalesce(F.sum("n_here"), F.lit(0)).alias("n"), F.sum(F.xxhash64("text_sha256", "id_here").cast("decimal(38,0)")).alias("h")).first()
        batch = batch or f"{said['n']}-{said['h']}"
        self._create(rows.schema["doc_id"].dataType.simpleString())
        new = checkpointed(self.unseen(best))
        first = new.select("text_sha256", F.col("id_here").alias("keep_id"), F.col("n_here").alias("group_size"), F.lit(True).alias("here"), "keep_row", "n_here")
        n_new = new.count()
        if n_new < said["digests"]:
            held = reduce(DataFrame.unionByName, [best.join(t.hint("merge"), "text_sha256") for t in self.tables()])
            again = F.col("batch") == batch
            old = held.select(
                "text_sha256",
                F.when(again, F.col("id_here")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.when(again, F.col("n_here")).otherwise(F.col("n_here") + F.col("n_rows")).alias("group_size"),
                again.alias("here"),
                "keep_row",
                "n_here",
            )
            first = first.unionByName(checkpointed(old))  # read before the index grows
        if n_new:
            self._append(new.select("text_sha256", F.col("id_here").alias("keep_id"), F.col("n_here").alias("n_rows"), F.lit(batch).alias("batch")))
            self._merge()
        out = lookup(rows, first, "text_sha256", "n_here", said["n"])
        return out.withColumn("kept", F.col("here") & (F.col("row") == F.col("keep_row")))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        return self.resolve(docs, id_col, text_col, batch).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def unique(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that the index keeps, all columns as they were: of equal texts one row, also where rows repeat.

    What goes is named by digest and id and taken out by an anti-join, by broadcast while it is small; beyond that texts are shuffled once.
    A null id is matched like any other. Columns may have any names.
    """
    found = index.resolve(docs, id_col, text_col, batch)
    # rows that repeat the kept one's text and id cannot be told from it by these: one of them stays
    same = F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = checkpointed(found.filter(~F.col("kept")).select(F.col("text_sha256").alias("__sha"), F.col("doc_id").alias("__id"), same.alias("__same")).distinct())
    sha = fresh_name(docs, "digest")
    marked = docs.withColumn(sha, digest(text_col))

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    def on(rows: DataFrame) -> Column:
        return (marked[sha] == rows["__sha"]) & marked[f"`{id_col}`"].eqNullSafe(rows["__id"])

    drop, repeat = side(gone.filter("not __same")), gone.filter("__same")
    left = marked.join(drop, on(drop), "left_anti")
    if repeat.count():
        repeat = side(repeat)
        n = fresh_name(left, "n")
        w = Window.partitionBy(sha, f"`{id_col}`").orderBy(F.desc(F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
        one = left.join(repeat, on(repeat), "left_semi").withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)
        left = left.join(repeat, on(repeat), "left_anti").unionByName(one)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
