"""SimHash near-dedup by multi-index hashing.

A document's 64-bit fingerprint has a bit where over half its word shingles' hashes have it. Fingerprints
within 3 bits agree in one of their two 32-bit segments but for at most one bit (floor(3 / 2)), so
enumerating the Hamming ball of radius 1 round each segment finds every pair; complete distances are
then verified. Only half of the ball is enumerated: of two segments that differ in one bit, one becomes
the other by clearing that bit.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from pathlake.llm.common import checkpointed, field, lookup, spread
from pathlake.llm.components import connected_components, least_rows, only_least, order

SEED = 42
MASK32 = 0xFFFFFFFF
#: Buckets (fingerprints that share a probed segment) over this size are split by the other segment's halves.
DENSE = 64


def shingle_hashes(text: str | None, shingle: int = 3) -> list[int]:
    """Hashes of one text's shingles: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words than a shingle are one, no words none."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])] or [xxh64_intdigest(joined, SEED)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text; no words: zero."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[lo : lo + (1 << 14)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return spread(rows).mapInArrow(run, T.StructType([field(rows, "doc_id"), T.StructField("fp", T.LongType())]))


def _ball(v, bits: int):
    """v (bits wide) and what it becomes by clearing any one bit."""
    cleared = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("getbit", v, i) == 1),
        lambda i: v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    return F.concat(F.array(v), cleared)


def _segment(s: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if s == 0 else F.col("fp").bitwiseAND(F.lit(MASK32))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hub_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links within `radius` bits of distinct fingerprints to hubs, which they share a half or a quarter with: six rows a fingerprint, however many share one.

    A hub is the one whose halves are shared most: of a text and its edited copies that is the text, and all within 3 bits of it have a quarter of its own.
    """
    quarter = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    parts = F.array(*[F.struct(F.lit(k).alias("s"), v.alias("v")) for k, v in enumerate([_segment(0), _segment(1), *quarter])])
    base = nodes.select("fp", F.explode(parts).alias("key"))
    sizes = checkpointed(base.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    n = 6 * nodes.count()
    base = checkpointed(lookup(base, sizes, "key", "size", n))
    shared = base.filter("key.s < 2").groupBy("fp").agg(F.sum("size").alias("shared"))
    ranked = base.join(shared, "fp", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("shared", F.lit(0)).alias("n"), "fp")).alias("h"), F.count("*").alias("size"))
    hubs = checkpointed(ranked.select("key", F.col("h.fp").alias("hub"), "size"))
    near = lookup(base.select("fp", "key"), hubs, "key", "size", n).filter((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= radius))
    return near.select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def links(nodes: DataFrame, radius: int = 3, roots: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints that differ in `radius` (at most 3) bits or fewer; with roots (node, root) only those of different roots.

    Complete: no bucket is capped. Members of a bucket over DENSE are keyed once more by a 16-bit half of
    the other segment (radius 1 again: at most 3 bits are left for two halves), so that fingerprints that
    share one segment by chance are not all compared.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius 1 find pairs within 3 bits")
    if roots is None:
        nodes = nodes.select("fp", F.col("fp").alias("r"))
    else:
        nodes = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("r"))
    base = nodes.select("fp", "r", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    base = base.select("fp", "r", "s", F.when(F.col("s") == 0, _segment(0)).otherwise(_segment(1)).alias("v"), F.when(F.col("s") == 1, _segment(0)).otherwise(_segment(1)).alias("o"))
    counts = base.groupBy("s", "v").count().filter(F.col("count") > DENSE).select(F.col("s").alias("hs"), F.col("v").alias("hv"), F.lit(True).alias("dense"))
    dense = lambda rows: rows.join(counts, (F.col("s") == F.col("hs")) & (F.col("v") == F.col("hv")), "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    stored = dense(base)
    # a probe of a dense bucket asks for it by halves
    probe = dense(base.select("fp", "r", "s", "o", F.explode(_ball(F.col("v"), 32)).alias("v")))
    halves = F.array(*[F.struct(F.lit(h).alias("h"), v.alias("w")) for h, v in enumerate((F.shiftright("o", 16), F.col("o").bitwiseAND(F.lit(0xFFFF))))])
    none = F.array(F.struct(F.lit(-1).alias("h"), F.lit(0).cast("long").alias("w")))
    ball16 = F.flatten(F.transform(halves, lambda x: F.transform(F.concat(_ball(x["w"], 16), F.transform(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.call_function("getbit", x["w"], i) == 0), lambda i: x["w"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))), lambda w: F.struct(x["h"].alias("h"), w.alias("w")))))
    stored = stored.select("fp", "r", "s", "v", F.explode(F.when(F.col("dense"), halves).otherwise(none)).alias("k")).select("fp", "r", "s", "v", "k.h", "k.w")
    probe = probe.select("fp", "r", "s", "v", F.explode(F.when(F.col("dense"), ball16).otherwise(none)).alias("k")).select(F.col("fp").alias("fq"), F.col("r").alias("rq"), "s", "v", "k.h", "k.w")
    pairs = stored.join(probe, ["s", "v", "h", "w"]).filter((F.col("r") != F.col("rq")) & (_distance("fp", "fq") <= radius))
    return pairs.select(F.least("fp", "fq").alias("a"), F.greatest("fp", "fq").alias("b")).distinct()


def roots_of(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """(node, root) of the fingerprints that are linked to another; root is the least one reachable.

    Links to hubs come first; after them only pairs of different components are made, so that a large group of fingerprints that are all
    near to each other doesn't give all its pairs.
    """
    near = checkpointed(connected_components(hub_links(nodes, radius), "a", "b"))
    rest = checkpointed(links(nodes, radius, near))
    return connected_components(near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, copies) of every row.

    component_id is the smallest doc_id reachable over links of `radius` bits or fewer; copies counts the rows
    with the same fingerprint. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows and equal texts share a fingerprint, which is linked once. An empty table gives no rows.
    Only doc_id and text are read.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    stars = roots_of(nodes.select("fp"), radius).withColumnRenamed("node", "fp")
    rooted = nodes.join(stars, "fp", "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id", "copies")
    return lookup(rows, checkpointed(classes), "fp", "copies", rows.count()).select("doc_id", "fp", "component_id", "copies")


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs that stand for their component, all columns as they were: of each component the row with its smallest doc_id (see only_least)."""
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), th.alias("th")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    rows = checkpointed(fingerprints(keyed, "key", "text", shingle).select("doc_id.doc_id", "doc_id.th", "fp"))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(order("doc_id")).alias("best"), F.count("*").alias("copies")))
    return only_least(docs, least_rows(rows, nodes, roots_of(nodes.select("fp"), radius), "fp"), id_col, text_col)
