"""What several operators share: tables, the shared folder, bounded samples, text chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pathlake.sources.shared import checkpointed, shared_dir  # noqa: F401  (for the operators and the pipeline)

#: A lookup side of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, like: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{like}"
    while name in taken:
        name += "_"
    return name


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out anew if they lie in fewer partitions than there are cores: a small file would leave the others idle. Larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def id_hash(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from. A null id counts as not held out."""
    return F.coalesce(id_hash(doc_id) == 1, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on cols alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(rows: DataFrame, text: str, label: str, key: str, per_class: int, max_bytes: int) -> list:
    """Rows (text, label) to learn from: about per_class of each label and never more than four times that in all.

    Rows are chosen by a hash of key, so that the sample does not depend on partitions or order; texts
    over max_bytes and rows without a label are left out. The result is small by construction: it grows with the
    number of labels alone, none of which is left out.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= max_bytes))
    counts = checkpointed(rows.groupBy(F.col(label).alias("__label")).agg(F.least(F.lit(1.0), per_class / F.count("*")).alias("__rate")))
    n_labels = counts.count()
    rates = F.broadcast(counts) if n_labels <= BROADCAST_ROWS else counts
    kept = rows.join(rates, F.col(label) == F.col("__label")).filter(unit_hash(F.col(key)) < F.col("__rate"))
    got = kept.select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).alias("key"))
    # an order, so that what the limit leaves does not depend on partitions either
    got = got.orderBy(unit_hash(F.col("key")), "key", "text").limit(4 * per_class * max(1, n_labels)).collect()
    return sorted(got, key=lambda r: (str(r["key"]), r["text"]))


def lookup(rows: DataFrame, unique: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows joined with the one row of unique for their key, whatever the skew.

    unique.size says how many rows have the key. Keys with over a thousandth of n_rows, at most 1,000
    keys, are broadcast; the others are joined by sort-merge, where no key is hot any more.
    """
    hot_at = max(1_000, n_rows // 1_000)
    hot = F.broadcast(unique.filter(F.col(size) > hot_at))
    cold = unique.filter(F.col(size) <= hot_at)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold.hint("merge"), key))


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers live on between tasks and would keep the most that any task took."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    """The field of a column that a Python function passes through."""
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def byte_chunks(texts: pa.Array, most: int = 1 << 20):
    """(first row, rows, bytes, offsets) of runs of rows with about `most` bytes of UTF-8; a longer row is alone. Null counts as empty."""
    a = texts.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same bytes with a space before and after each text; where each text begins and ends with its spaces."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    starts = offsets[:-1] + 2 * np.arange(n)
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, lengths)] = data
    return out, starts, starts + lengths + 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict]:
    """([(text, label)], rows by label) to learn from: about per_class documents of each label, never more than four times that in all.

    labels has id_col and label; `learn` says of an id whether it may be learned from. Ids are chosen on the small
    table, by hash, and their number is what is broadcast to fetch the texts. Of repeated ids in labels the greatest label counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn)
    known = known.groupBy(id_col).agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep |= (F.col("label") == F.lit(value)) & (unit_hash(F.col(id_col)) < F.lit(min(1.0, per_class / n)))
    most = 4 * per_class * max(1, len(counts))
    ids = known.filter(keep).orderBy(unit_hash(F.col(id_col)), id_col).limit(most).collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r[id_col], r["label"]) for r in ids], known.schema)
    texts = docs.filter(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= max_bytes)).select(F.col(id_col), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(chosen), id_col).orderBy(unit_hash(F.col(id_col)), id_col, "text").limit(most).collect()
    return [(r["text"], int(r["label"])) for r in sorted(got, key=lambda r: (str(r[id_col]), r["text"]))], counts


def _numbered(key: str):
    """Numbers each run of equal keys in a sorted partition, from 1; what is kept between batches is the last key and its count."""

    def number(batches):
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            ends = np.asarray(pc.run_end_encode(keys).run_ends)
            starts = np.concatenate([[0], ends[:-1]])
            at = np.arange(1, n + 1) - np.repeat(starts, ends - starts)
            first, final = keys[0].as_py(), keys[n - 1].as_py()
            if seen and first == last:
                at[: ends[0]] += seen
            last, seen = final, int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at, pa.int64())], names=[*batch.schema.names, "__part", "pos"])

    return number


def placed(rows: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The columns `keep` of rows, and `pos`: a row's place among those of its key, from 1, in the given order. Written to the shared folder.

    Rows are dealt out by ranges of (key, *order), so a key with a third of all rows lies in many tasks, and each task numbers its own. A range
    begins with at most one key of the range before, so what has to be added to it is a row a partition, and is broadcast. Null keys are one key.
    """
    by = [F.col(key).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep)
    schema = T.StructType([*dealt.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("pos", T.LongType())])
    at = checkpointed(dealt.mapInArrow(_numbered(key), schema))
    runs = at.groupBy(key, "__part").agg(F.max("pos").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carry = runs.select(F.col(key).alias("__key"), F.col("__part").alias("__in"), before.alias("__before")).filter("__before > 0")
    whole = at.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__in")), "left")
    return whole.withColumn("pos", F.col("pos") + F.coalesce("__before", F.lit(0))).drop("__part", "__key", "__in", "__before")


#: Places of a key that one window sees.
SCAN = 4096


def scanned(rows: DataFrame, key: list[str], pos: Column, values: dict[str, Column], fold) -> DataFrame:
    """rows with each of `values` folded over its key's rows up to its own, in order of pos (no two of a key are the same).

    fold is an associative aggregate (F.sum, F.max, F.bit_xor). A window sees SCAN places; of longer keys, blocks are folded first and what lies before
    each is joined to it, a row a block: no task sees a long key whole. `rows` is read twice and should be stored.
    """
    rows = rows.withColumn("__at", pos).withColumn("__block", F.floor(F.col("__at") / SCAN))
    rows = rows.withColumns({f"__v{i}": v for i, v in enumerate(values.values())})
    blocks = rows.groupBy(*key, "__block").agg(*[fold(f"__v{i}").alias(f"__v{i}") for i in range(len(values))])
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    least = blocks.withColumn("__first", F.row_number().over(Window.partitionBy(*key).orderBy("__block")))
    carry = least.select(*key, "__block", "__first", *[fold(f"__v{i}").over(earlier).alias(f"__c{i}") for i in range(len(values))]).filter("__first > 1").drop("__first")
    here = Window.partitionBy(*key, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__w{i}": fold(f"__v{i}").over(here) for i in range(len(values))}).join(small(carry), [*key, "__block"], "left")
    both = {name: _fold2(fold, F.col(f"__w{i}"), F.col(f"__c{i}")) for i, name in enumerate(values)}
    return out.select(*[c for c in rows.columns if not c.startswith("__")], *[c.alias(n) for n, c in both.items()])


def _fold2(fold, a: Column, b: Column) -> Column:
    if fold is F.max:
        return F.greatest(a, b)
    if fold is F.bit_xor:
        return a.bitwiseXOR(F.coalesce(b, F.lit(0)))
    return a + F.coalesce(b, F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """df, stored, and to be broadcast if it has at most BROADCAST_ROWS rows."""
    stored = checkpointed(df)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def sha256_in_order(pieces: DataFrame, key: list[str], order: str, piece: str, name: str, sep: str = "") -> DataFrame:
    """(key, name): the SHA-256 of each key's pieces, joined by sep in the given order. A digest is taken piece by piece: a key's whole text is never held."""
    fields = [*key, piece]
    schema = T.StructType([*[pieces.schema[k] for k in key], T.StructField(name, T.StringType())])

    def digest(batches):
        import hashlib

        last, state = None, None
        for batch in batches:
            done = []
            for *k, text in zip(*[batch.column(batch.schema.get_field_index(f)).to_pylist() for f in fields]):
                if k != last:
                    if state is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = k, hashlib.sha256()
                else:
                    state.update(sep.encode())
                state.update(text.encode())
            if done:
                yield _batch(done, out)
        if state is not None:
            yield _batch([(*last, state.hexdigest())], out)

    out = to_arrow_schema(schema)
    dealt = pieces.select(*fields, order).repartition(*key).sortWithinPartitions(*key, order).select(*fields)
    return dealt.mapInArrow(digest, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
