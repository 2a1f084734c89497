"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

1. Windows: a window can only be similar to an item if they share a shingle, so windows are laid where a
   document's shingle is one of the benchmark's, each with the item's size and so that the shared shingles meet.
   Every way in which an item and a document line up is looked at; windows that share nothing are not fingerprinted.
2. Every window gets a 64-bit SimHash. Four 16-bit blocks, each looked up in the Hamming balls of radius 4 round
   the items' blocks, find every item within RADIUS = 19 bits (20 differing bits would be needed to differ in 5
   bits in every block); complete distances are then verified.
3. What is left is verified by the exact Jaccard similarity of the shingle multisets: the weighted one or, as phrases that many
   items share weigh little and a changed word weighs 1, the plain one.

Built-in functions only; texts are read once a pass and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.llm.common import BROADCAST_ROWS, checkpointed, field

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Benchmark shingles of one pass over the documents; larger benchmarks take several passes.
PASS_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Lower-cased words between white space (0x20, 0x09-0x0D); null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")


def _shingles(df: DataFrame, arity: int, out: str) -> DataFrame:
    """df (with array `w` of words) plus `out`: hashes of runs of `arity` words. Built by pairing shifted arrays, without copies of strings."""
    df = df.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    tail = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    # the last elements, which have no partner, are cut off
    both = lambda a, b: F.slice(F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)), 1, F.size(b))
    have, name = 1, "h1"
    while have < arity:
        step = min(have, arity - have)
        if step == have:
            df = df.withColumn(f"h{2 * have}", both(F.col(name), tail(name, have)))
        else:  # one word more
            step = 1
            df = df.withColumn(f"h{have + 1}", both(F.col(name), tail("h1", have)))
        have += step
        name = f"h{have}"
    drop = [c for c in df.columns if c.startswith("h") and c[1:].isdigit() and c != name]
    return df.drop(*drop).withColumnRenamed(name, out)


def simhash(hashes: str) -> Column:
    """64 bits, each set if over half of the hashes have it."""
    bit = lambda b: F.when(
        2 * F.size(F.filter(hashes, lambda x: F.call_function("getbit", x, b) == 1)) > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)
    ).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _blocks(fp: str) -> list[Column]:
    return [F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long")) for b in range(4)]


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ids, n, arity, s, fp, weights) of every distinct item text that has words; an item under SHINGLE words is one shingle.

    item is a key of our own, ids the item_ids of the rows with that text, null ones too, so that neither null nor repeated ids or rows are lost.

    A shingle's weight falls with the number of distinct item texts that hold it, so that phrases common to many items count less.
    Of repeated item ids each text is an item. The benchmark is small beside the documents.
    """
    base = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    # in a struct, as collect_set leaves out nulls
    base = base.groupBy("w").agg(F.collect_set(F.struct("item_id")).alias("ids"))
    base = base.withColumn("item", F.monotonically_increasing_id()).withColumn("n", F.size("w")).withColumn("arity", F.least(F.col("n"), F.lit(SHINGLE)))
    base = checkpointed(base)
    out = None
    for arity in range(1, SHINGLE + 1):
        part = _shingles(base.filter(F.col("arity") == arity), arity, "s").drop("w")
        out = part if out is None else out.unionByName(part)
    out = checkpointed(out.withColumn("fp", simhash("s")))
    each = out.select("item", F.explode(F.array_distinct("s")).alias("h"))
    df = each.groupBy("h").agg(F.count("*").alias("df"))
    w = each.join(df, "h").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("h", 1 / (1 + F.log("df"))))).alias("weights"))
    return checkpointed(out.join(w, "item"))


def _anchored(docs: DataFrame, shingles: DataFrame, arity: int) -> DataFrame:
    """Windows (doc_id, start, n, win) of all documents where a shingle of the benchmark stands; shingles: h, pos, n."""
    s = _shingles(docs, arity, "s").drop("w")
    # outer: from an inner one Spark infers a filter on the array's size, which computes every array twice; the join drops the nulls
    at = s.select("doc_id", "s", F.posexplode_outer("s").alias("at", "h"))
    hit = at.join(F.broadcast(shingles), "h")  # the array stays a reference until a row matches
    first = F.col("at") - F.col("pos")
    begin = F.greatest(first, F.lit(0))
    length = F.col("n") - arity + 1 - (begin - first)
    return hit.select("doc_id", begin.alias("start"), "n", F.slice("s", begin + 1, length).alias("win"))


def windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    table = items.select("n", "arity", F.posexplode("s").alias("pos", "h")).select("h", "pos", "n", "arity").distinct()
    table = checkpointed(table.withColumn("part", F.pmod(F.col("h"), F.lit(max(1, -(-table.count() // PASS_SHINGLES))))))
    found = None
    for arity, part in sorted(tuple(r) for r in table.select("arity", "part").distinct().collect()):  # 5 arities at most, a part each PASS_SHINGLES
        piece = table.filter((F.col("arity") == arity) & (F.col("part") == part)).select("h", "pos", "n")
        got = _anchored(base, piece, arity)
        found = got if found is None else found.unionByName(got)
    if found is None:
        nothing = T.StructType([field(docs, id_col, "doc_id"), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("content", T.LongType()), T.StructField("win", T.ArrayType(T.LongType()))])
        return docs.sparkSession.createDataFrame([], nothing)
    # the anchors of one window are one row before anything is shuffled
    found = found.withColumn("content", F.xxhash64("win"))
    return checkpointed(found.groupBy("doc_id", "start", "n", "content").agg(F.first("win").alias("win")))


def _similarity(weighted: bool) -> tuple[Column, Column]:
    """What multisets win and s have in common and in both, by weight or by number; a shingle that no item holds weighs 1."""
    weight = lambda x: F.coalesce(F.element_at("weights", x), F.lit(1.0)) if weighted else F.lit(1.0)
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + weight(x))
    common = F.aggregate(F.array_intersect("win", "s"), F.lit(0.0), lambda t, x: t + weight(x) * F.least(count(F.col("win"), x), count(F.col("s"), x)))
    return common, total("win") + total("s")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, hamming, start, n_windows): every document with a window that is an item, or nearly.

    similarity, at least SIMILARITY, is the best window's, weighted unless only the plain one is so high; start its first word, hamming the least distance.
    Null and empty texts and items match nothing; repeated rows of a document count as one document; a null doc_id is
    reported as null; without rows on either side the result is empty. Other columns are not read.
    """
    items = items_of(benchmark, item_col, item_text)
    wins = windows(docs, items, id_col, text_col)
    # each distinct content is fingerprinted and verified once: a passage in a third of all documents is one row
    content = wins.groupBy("content", "n").agg(F.first("win").alias("win"))
    content = checkpointed(content.withColumn("fp", simhash("win")))
    keys = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), v.alias("v")) for b, v in enumerate(_blocks("fp"))])).alias("k")
    ball = F.lit([m for m in range(1 << 16) if m.bit_count() <= RADIUS // 4])
    # a window has the size of its item, so the blocks of one size are looked up among those of that size alone; never by broadcast: the balls are large
    probe = items.select("n", "fp").distinct().select("n", F.col("fp").alias("item_fp"), keys).select("n", "item_fp", "k.b", "k.v", F.explode(ball).alias("m"))
    probe = probe.select("n", "item_fp", "b", F.col("v").bitwiseXOR(F.col("m").cast("long")).alias("v"))
    near = content.select("n", "fp").distinct().select("n", "fp", keys).select("n", "fp", "k.b", "k.v").hint("merge").join(probe.hint("merge"), ["n", "b", "v"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = near.filter(distance <= RADIUS).select("n", "fp", "item_fp", distance.alias("hamming")).distinct()
    cand = content.join(near, ["n", "fp"]).drop("fp")
    cand = cand.join(items.select("ids", F.col("fp").alias("item_fp"), "n", "s", "weights"), ["n", "item_fp"])
    good = cand
    for name, (common, both) in (("weighted", _similarity(True)), ("plain", _similarity(False))):
        good = good.withColumn("common", common).withColumn("both", both).withColumn(name, F.try_divide(F.col("common"), F.col("both") - F.col("common")))
    good = good.withColumn("similarity", F.when(F.col("weighted") >= SIMILARITY, F.col("weighted")).otherwise(F.col("plain"))).filter(F.col("similarity") >= SIMILARITY)
    good = good.select("content", "n", F.explode("ids").alias("id"), "similarity", "hamming").select("content", "n", "id.item_id", "similarity", "hamming")
    good = checkpointed(good)
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    found = wins.select("doc_id", "start", "n", "content").join(good, ["content", "n"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best, F.min("hamming").alias("hamming"), F.count("*").alias("n_windows")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), F.col("hamming").cast("int").alias("hamming"), (-F.col("best.start")).alias("start"), "n_windows"
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were. Rows go by their own text, whatever their ids."""
    keyed = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    bad = checkpointed(contaminated(keyed, benchmark, "key", "text").select(F.col("doc_id").alias("__bad")).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, F.xxhash64(docs[text_col]) == bad["__bad"], "left_anti")
