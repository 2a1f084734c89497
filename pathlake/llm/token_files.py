"""Token ids in files of patched frame-of-reference blocks.

A file is one run of documents, at most FILE_IDS ids unless one document alone has more. Numbers are little-endian:

    "PFOR" u32 block   u64 ids   u32 documents   u32 blocks
    u64 * documents    ids of each document
    u64 * (blocks + 1) where each block begins, from the start of the block area; the last is its end
    blocks             u32 least id, u16 exceptions, u8 width, u8 0; packed (id - least), `width` bits each, low bits first;
                       exceptions: u16 * n places, u32 * n values (id - least)

A block's width is that of its PERCENTILE-th percentile; wider values are exceptions and zero in the packed part. As blocks are indexed, a few ids are
read without unpacking the rest. Files are rows of a Parquet table (part, file, doc_ids, n_ids, data): tasks write them through Spark to any store,
a task that is lost is written again, and (part, file) is their order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK, PERCENTILE, FILE_IDS = 1024, 90, 1 << 20
#: Bytes of texts whose words are encoded together, and words whose ids are put in place at once.
RUN, WORDS = 24 << 20, 1 << 18
MAGIC = b"PFOR"
WHITE = b" \t\n\x0b\x0c\r"


# --- files


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _packed(deltas: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2^width as rows of bytes."""
    bits = (deltas[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(deltas), -1), axis=1, bitorder="little")


def _unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    """The inverse: rows of n values."""
    bits = np.unpackbits(raw, axis=1, count=n * width, bitorder="little").reshape(len(raw), n, width)
    out = np.zeros((len(raw), n), np.uint32)
    for b in range(width):
        out |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    return out


def _blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of the rows of a matrix of ids."""
    low = ids.min(axis=1)
    deltas = ids - low[:, None]
    k = max(0, -(-ids.shape[1] * PERCENTILE // 100) - 1)
    width = _widths(np.partition(deltas, k, axis=1)[:, k])
    over = deltas >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    flat = np.where(over, 0, deltas).astype(np.uint32)
    out: list[bytes] = [b""] * len(ids)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for lo in range(0, len(rows), 128):
            some = rows[lo : lo + 128]
            raw = _packed(flat[some], int(w)) if w else np.zeros((len(some), 0), np.uint8)
            for r, data in zip(some, raw):
                places = np.flatnonzero(over[r])
                head = low[r].tobytes() + np.uint16(len(places)).tobytes() + bytes((int(w), 0))
                out[r] = head + data.tobytes() + places.astype("<u2").tobytes() + deltas[r, places].astype("<u4").tobytes()
    return out


def pack(ids: np.ndarray, lengths: list[int]) -> bytes:
    """A file of the ids of documents, one after the other."""
    ids = np.ascontiguousarray(ids, "<u4")
    full = len(ids) // BLOCK * BLOCK
    blocks: list[bytes] = []
    for lo in range(0, full, BLOCK << 8):  # 256 blocks at once
        blocks += _blocks(ids[lo : min(full, lo + (BLOCK << 8))].reshape(-1, BLOCK))
    if full < len(ids):
        blocks += _blocks(ids[full:].reshape(1, -1))
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = MAGIC + np.uint32(BLOCK).tobytes() + np.uint64(len(ids)).tobytes() + np.array([len(lengths), len(blocks)], "<u4").tobytes()
    return b"".join([head, np.array(lengths, "<u8").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """A file that pack() made."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.block = data, int(np.frombuffer(data, "<u4", 1, 4)[0])
        self.n_ids = int(np.frombuffer(data, "<u8", 1, 8)[0])
        n_docs, n_blocks = (int(x) for x in np.frombuffer(data, "<u4", 2, 16))
        self.lengths = np.frombuffer(data, "<u8", n_docs, 24).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_blocks + 1, 24 + 8 * n_docs).astype(np.int64)
        self.area = 24 + 8 * n_docs + 8 * (n_blocks + 1)

    def ids(self, first: int = 0, n: int | None = None) -> np.ndarray:
        """n ids from `first` on; only the blocks that hold them are read."""
        end = self.n_ids if n is None else min(self.n_ids, first + n)
        if first >= end:
            return np.zeros(0, np.uint32)
        lo, hi = first // self.block, -(-end // self.block)
        out = np.empty((hi - lo) * self.block, np.uint32)
        same: dict[int, list[int]] = {}
        for b in range(lo, hi):
            same.setdefault(self.data[self.area + self.starts[b] + 6] if (b + 1) * self.block <= self.n_ids else -1, []).append(b)
        for width, blocks in same.items():
            for at in range(0, len(blocks), 128):
                self._read(blocks[at : at + 128], width, out, lo)
        return out[first - lo * self.block : end - lo * self.block]

    def _read(self, blocks: list[int], width: int, out: np.ndarray, lo: int) -> None:
        n = self.block
        if width < 0:  # the last block, with fewer ids
            n, width = self.n_ids - blocks[0] * self.block, self.data[self.area + self.starts[blocks[0]] + 6]
        size = -(-n * width // 8)
        begin = [int(self.area + self.starts[b]) for b in blocks]
        raw = np.stack([np.frombuffer(self.data, np.uint8, size, at + 8) for at in begin])
        values = _unpacked(raw, n, width) if width else np.zeros((len(blocks), n), np.uint32)
        for row, at, b in zip(values, begin, blocks):
            low, n_over = np.frombuffer(self.data, "<u4", 1, at)[0], int(np.frombuffer(self.data, "<u2", 1, at + 4)[0])
            if n_over:
                row[np.frombuffer(self.data, "<u2", n_over, at + 8 + size)] = np.frombuffer(self.data, "<u4", n_over, at + 8 + size + 2 * n_over)
            out[(b - lo) * self.block : (b - lo) * self.block + n] = row + low


# --- ids


def text_pieces(text: bytes, most: int | None = None) -> Iterator[bytes]:
    """text in runs of some `most` bytes, cut behind white space; a longer word is not cut."""
    most, lo = most or RUN, 0
    while len(text) - lo > most:
        hi = lo + most
        while hi < len(text) and text[hi] not in WHITE:
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


#: Letters that lower-casing and normalisation keep apart, one for one: Latin and Cyrillic. Fixed by Unicode.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f\u0400-\u0481\u048a-\u052f"
#: ASCII marks but the apostrophe, which begins endings of its own: behind a letter, a run of them is a piece of its own.
MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Words of such letters with such marks behind them.
PLAIN = f"^(?P<stem>[{LETTERS}]+)(?P<marks>[{MARKS}]*)$"


class Encoder:
    """Ids of texts, by a tokenizer that drops white space and joins nothing over it: each word of a run of texts is encoded once.

    Words of letters are encoded some hundreds at a time, as one text, without case and the marks behind them: each ends in one token that ends a word,
    which tells them apart. Other words are encoded one by one. Nothing is kept between runs.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        suffix = self.tokenizer.model.end_of_word_suffix
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(names.values(), default=0) + 1, bool)
        if suffix:
            self.final[[i for name, i in names.items() if name.endswith(suffix)]] = True

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words = lists.flatten().dictionary_encode()
        del lists
        at = words.indices.to_numpy(zero_copy_only=False)
        flat, starts, sizes, two = self._vocabulary(words.dictionary)
        lo = first = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, first + WORDS, "right")))
            # a word is two pieces of the flat table, the second often empty
            pieces = two[at[first : ends[hi - 1]]].reshape(-1)
            n = sizes[pieces]
            done = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.arange(int(done[-1])) + np.repeat(starts[pieces] - done[:-1], n)]
            yield from np.split(ids, done[2 * (ends[lo : hi - 1] - first)])
            lo, first = hi, int(ends[hi - 1])

    def _vocabulary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces in one array, where each piece begins and how many it has, and the two pieces of each word; piece 0 is empty."""
        parts = pc.extract_regex(words, PLAIN) if self.final.any() else pa.nulls(len(words), pa.struct([("stem", pa.large_string()), ("marks", pa.large_string())]))
        two = np.zeros((len(words), 2), np.int64)
        tables = [[np.zeros(0, "<u4")]]
        n = 1
        plain = np.asarray(parts.is_valid())
        for column, name, encode in ((0, "stem", self._together), (1, "marks", self._one_by_one)):
            found = pc.utf8_lower(parts.filter(plain).field(name)).dictionary_encode()
            two[plain, column] = n + found.indices.to_numpy(zero_copy_only=False)
            tables.append(encode(found.dictionary.to_pylist()))
            n += len(tables[-1])
        other = np.flatnonzero(~plain)
        two[other, 0] = n + np.arange(len(other))
        tables.append(self._one_by_one(words.take(pa.array(other)).to_pylist()))
        ids = [x for t in tables for x in t]
        sizes = np.array([len(x) for x in ids])
        return np.concatenate(ids), np.cumsum(sizes) - sizes, sizes, two

    def _together(self, stems: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo in range(0, len(stems), 500):
            some = stems[lo : lo + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            out += np.split(ids, ends[:-1]) if len(ends) == len(some) else self._one_by_one(some)
        return out

    def _one_by_one(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for lo in range(0, len(words), 1000) for e in self.tokenizer.encode_batch_fast(words[lo : lo + 1000], add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """One a worker: it lives on between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _encoded(encode: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    """(document, ids) of each row of batches (document, text); texts are encoded some RUN bytes at a time, a longer text in pieces."""
    names, texts, held = [], [], 0

    def run() -> Iterator[tuple[object, np.ndarray]]:
        yield from zip(names, encode(pa.array(texts, pa.large_binary())))

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
            raw = text.as_py()
            if len(raw) > RUN:
                yield from run() if names else ()
                names, texts, held = [], [], 0
                yield doc.as_py(), np.concatenate([next(encode(pa.array([p], pa.large_binary()))) for p in text_pieces(raw)])
                continue
            names.append(doc.as_py())
            texts.append(raw)
            held += len(raw)
            if held > RUN:
                yield from run()
                names, texts, held = [], [], 0
    if names:
        yield from run()


# --- tables


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts in ascending order of ids and writes them as files to a folder that all share.

    Null texts count as empty: such a document has its end id alone. Null ids come first; repeated ids go by their text. An empty table gives no files.
    Ranges of ids are dealt to tasks; a task holds one file at a time. Other columns are not read, whatever their names.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("file", T.LongType()), T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, n = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def one() -> pa.RecordBatch:
            data = pack(np.concatenate(ids), [len(x) for x in ids])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, n, names, held, data), arrow)], schema=arrow)

        for doc, found in _encoded(encode, batches):
            found = np.concatenate([found, end])
            if ids and held + len(found) > FILE_IDS:
                yield one()
                ids, names, held, n = [], [], 0, n + 1
            ids.append(found)
            names.append(doc)
            held += len(found)
        if ids:
            yield one()

    by = [F.col("doc_id").asc_nulls_first()]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    dealt.mapInArrow(files, schema).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: how many ids all documents before it have, how many its own, and the
    CRC-32 of its ids as little-endian 32-bit numbers."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a number a task that wrote
    offsets, total = [], 0
    for r in parts:
        offsets.append((r["part"], total))
        total += r["n"]
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = files.select("part", "file", "n_ids").withColumn("first", before).drop("n_ids")
    table = spark.createDataFrame(offsets, "part int, offset long")
    first = first.join(F.broadcast(table), "part").select("part", "file", (F.col("first") + F.col("offset")).alias("first"))
    digests = files.select("part", "file", "doc_ids", "data").mapInArrow(*_digests(files.schema["doc_ids"].dataType.elementType))
    return digests.join(first, ["part", "file"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _digests(id_type: T.DataType):
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("file", T.LongType()), T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("at", "n_tokens", "ids_crc32")]]
    )
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, file, names = (batch.column(c)[i].as_py() for c in range(3))
                f = TokenFile(batch.column(3)[i].as_py())
                raw = memoryview(np.ascontiguousarray(f.ids(), "<u4")).cast("B")
                ends = np.cumsum(f.lengths)
                starts = ends - f.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                cols = ([part] * len(names), [file] * len(names), names, starts, f.lengths, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, arrow)], schema=arrow)

    return digest, schema


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document, from the files."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data in zip(batch.column(0), batch.column(1)):
                f = TokenFile(data.as_py())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(f.lengths)]), pa.int32()), pa.array(f.ids(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names.as_py(), arrow.field(0).type), lists.cast(arrow.field(1).type)], schema=arrow)

    return files.select("doc_ids", "data").mapInArrow(unpacked, schema)
