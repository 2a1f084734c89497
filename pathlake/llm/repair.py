"""Repair of conversations' structure: the cheapest edits after which roles read (s?(ua)+)?.

Dijkstra's search runs on an implicit lattice. A node is (turns taken, grammar state); the states are nothing said yet, after a system turn, after a user turn, after an
assistant turn. Edges: Keep a turn whose initial fits (0), Rerole it to user or assistant (2), Delete it (3, the only way past blank and repeated turns), Insert an empty
user or assistant turn (2); a truncated turn that stays costs 1 more. The priority is (cost, audit), the audit being the initials of the edits so far; the first
accepting end node that is popped ends the search. Two audits of one cost that lead to one node are never prefixes of each other (an Insert costs 2),
so the least audit of a node is the least beginning of every audit through it, and the search is right for ties.

That also lets a long conversation be cut. Turns are taken in blocks of BLOCK places, which are never joined to one group. In a conversation that fits in one block the search is
as above. In a longer one each block is searched from each state it can begin in to each it can end in, side by side; then the blocks' borders are
the lattice, read in order, and what all borders agree on is settled and let go. So neither a task nor a group holds a long conversation.
"""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pathlake.llm.common import checkpointed, placed, sha256_in_order

#: Places of a block.
BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Fixed: white space of the contract, and what ends a turn that is whole.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: State after a turn with this initial: 0 nothing said, 1 after s, 2 after u, 3 after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
SPOKEN = {"u": "user", "a": "assistant"}


# --- the search


def search(symbols: str, begin: int = 0, ends: tuple[int, ...] = FINAL) -> tuple[int, str, int] | None:
    """(cost, audit, state) of the first accepting end node. symbols has two characters a turn: its role's initial and its fault, one of "-bdt" (none, blank, duplicate, truncated)."""
    n = len(symbols) // 2
    heap, done = [(0, "", 0, begin)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            return cost, audit, state
        for initial in "ua":
            if initial in NEXT[state]:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state][initial]))
        if i == n:
            continue
        initial, fault = symbols[2 * i], symbols[2 * i + 1]
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if fault in "bd":
            continue
        more = TRUNCATED * (fault == "t")
        if initial in NEXT[state]:
            heapq.heappush(heap, (cost + KEEP + more, audit + "K", i + 1, NEXT[state][initial]))
        for other in "ua":
            if other in NEXT[state]:
                heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, NEXT[state][other]))
    return None


def spelled(symbols: str, audit: str, state: int = 0) -> tuple[list[str], int]:
    """For each turn what it becomes: inserted initials, then "K", "R" with the new initial, or "D"; inserts after the last turn are an item of their own. And the state at the end.

    The grammar leaves one reading of an audit: behind an s, turns alternate from u.
    """
    out, i, before = [], 0, ""
    for edit in audit:
        if edit == "D":
            out.append(before + "D")
        elif edit == "K":
            state = NEXT[state][symbols[2 * i]]
            out.append(before + "K")
        else:
            new = "a" if state == 2 else "u"
            state = NEXT[state][new]
            if edit == "I":
                before += new
                continue
            out.append(before + "R" + new)
        i, before = i + 1, ""
    return [*out, before], state


def _counts(symbols: str) -> tuple[int, int, int, int]:
    """Blank, repeated and truncated turns, and adjacent roles that may not follow each other."""
    faults, roles = symbols[1::2], symbols[::2]
    pairs = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    return faults.count("b"), faults.count("d"), faults.count("t"), pairs


SOLVED = T.StructType(
    [
        T.StructField("codes", T.ArrayType(T.StringType())),
        T.StructField("audit", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")],
    ]
)


@F.pandas_udf(SOLVED)
def _solved(symbols: pd.Series) -> pd.DataFrame:
    rows = []
    for s in symbols:
        cost, audit, _ = search(s)
        rows.append((spelled(s, audit)[0], audit, cost, *_counts(s)))
    return pd.DataFrame(rows, columns=SOLVED.names)


BORDERS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


@F.pandas_udf(BORDERS)
def _borders(symbols: pd.Series) -> pd.Series:
    """The cheapest edits of a block from each state to each state that it can reach."""

    def of(s: str) -> list:
        found = []
        for begin in range(4):
            for end in range(4):
                if hit := search(s, begin, (end,)):
                    found.append({"begin": begin, "end": end, "cost": hit[0], "audit": hit[1]})
        return found

    return symbols.map(of)


PART = T.StructType([T.StructField("block", T.LongType()), T.StructField("codes", T.ArrayType(T.StringType())), *SOLVED.fields[1:]])


class _Long:
    """The borders of one long conversation, in order: the best (cost, audits of blocks that are not settled) of each state. Cost, counts and audit of a block are put out with it."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, tuple[str, ...]]] = {0: (0, ())}
        self.open: list[tuple[int, str]] = []  # (block, symbols) that are not settled
        self.state, self.paid, self.last = 0, 0, ""

    def add(self, block: int, symbols: str, edges: list[dict]) -> list[tuple]:
        new: dict[int, tuple[int, tuple[str, ...]]] = {}
        for e in edges:
            if e["begin"] in self.best:
                cost, audits = self.best[e["begin"]]
                to = (cost + e["cost"], (*audits, e["audit"]))
                old = new.get(e["end"])
                if old is None or to[0] < old[0] or (to[0] == old[0] and "".join(to[1]) < "".join(old[1])):
                    new[e["end"]] = to
        self.best = new
        self.open.append((block, symbols))
        return self._settled()

    def finish(self) -> list[tuple]:
        self.best = {0: min((c, "".join(a), a) for s, (c, a) in self.best.items() if s in FINAL)[0::2]}
        return self._settled()

    def _settled(self) -> list[tuple]:
        """Blocks whose audit is the same in all that is left."""
        out = []
        while self.open and len({a[0] for _, a in self.best.values()}) == 1:
            (block, symbols), audit = self.open.pop(0), next(iter(self.best.values()))[1][0]
            self.best = {s: (c, a[1:]) for s, (c, a) in self.best.items()}
            codes, self.state = spelled(symbols, audit, self.state)
            cost = sum({"D": DELETE, "R": REROLE, "I": INSERT, "K": KEEP}[x] for x in audit)
            cost += TRUNCATED * sum(f == "t" and not c.endswith("D") for f, c in zip(symbols[1::2], codes))
            b, d, t, pairs = _counts(symbols)
            pairs += bool(self.last) and self.last + symbols[0] not in ("su", "ua", "au")
            self.last = symbols[-2]
            out.append((block, codes, audit, cost, b, d, t, pairs))
        return out


def _chained(conv_type: T.StructField):
    schema = T.StructType([conv_type, *PART.fields])
    arrow = to_arrow_schema(schema)

    def chain(batches):
        last, state = None, None
        for batch in batches:
            done = []
            for conv, block, symbols, edges in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != last:
                    if state is not None:
                        done += [(last, *r) for r in state.finish()]
                    last, state = conv, _Long()
                done += [(conv, *r) for r in state.add(block, symbols, edges)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if state is not None and (done := [(last, *r) for r in state.finish()]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

    return chain, schema


# --- rows


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, lost): rows as a careless export would leave them, by a hash of conversation and turn; lost ones are marked, not left out."""
    written = lambda c: F.coalesce(rows[f"`{c}`"].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written(conv), F.lit(":"), written(turn))) % 20
    said = rows.select(rows[f"`{conv}`"].alias("conv"), rows[f"`{turn}`"].alias("turn"), written(role).alias("role"), written(text).alias("text"), kind.alias("kind"))
    said = said.withColumns(
        {
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
            "times": F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))),
        }
    )
    return said.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("lost"))


def _initial(role: Column) -> Column:
    """A role's first character; a role without one or with one outside the plain letters fits nowhere."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("-")


def _pieces(row: Column, code: Column) -> Column:
    """The lines that a turn becomes, as an array: inserted turns, then itself unless it is deleted."""
    body = F.regexp_extract(code, "^([ua]*)(.*)$", 1)
    what = F.regexp_extract(code, "^([ua]*)(.*)$", 2)
    added = F.when(F.char_length(body) > 0, F.transform(F.split(body, ""), lambda c: F.when(c == "u", "user:").otherwise("assistant:"))).otherwise(F.array().cast("array<string>"))
    own = F.when(what == "K", F.array(F.concat(row["role"], F.lit(":"), row["text"])))
    own = own.when(what == "Ru", F.array(F.concat(F.lit("user:"), row["text"]))).when(what == "Ra", F.array(F.concat(F.lit("assistant:"), row["text"])))
    return F.concat(added, own.otherwise(F.array().cast("array<string>")))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row a conversation, of rows (conv, turn, role, text, lost).

    Lost rows aren't part of their conversation, but it is reported: with zeros, an empty audit and an empty text's hash if nothing else is left.
    Rows are ordered by turn (null first), then role and text, so ties and repeated rows have a defined place. A null conversation is one like any other. An empty table gives no rows.
    """
    left = rows.filter("NOT lost").select("conv", "turn", "role", "text")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", "b").when(~F.substring(bare, -1, 1).isin(*ENDS), "t").otherwise("-")
    left = left.withColumns({"initial": _initial(F.col("role")), "fault": fault})
    whole = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    left = left.withColumn("digest", F.unhex(F.substring(whole, 1, 32)))
    at = placed(left, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], left.columns)
    at = checkpointed(at.withColumns({"pos": F.col("pos") - 1, "block": F.floor((F.col("pos") - 1) / BLOCK)}))

    first = at.groupBy("conv", "digest").agg(F.min("pos").alias("pos"))
    same = lambda a, b, *more: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & F.col(f"{a}.{more[0]}").eqNullSafe(F.col(f"{b}.{more[0]}"))
    # the first place of each text, not the text itself, is what is joined: no key is hot, however often a text is repeated
    again = at.select("conv", "pos", "block").alias("a").join(first.alias("b"), same("a", "b", "pos"), "left_anti")
    again = again.groupBy("conv", "block").agg(F.collect_list("pos").alias("again"))
    groups = at.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "initial", "fault"))).alias("turns"))
    groups = groups.alias("a").join(again.alias("b"), same("a", "b", "block"), "left").select("a.*", "b.again")
    fault = lambda t: F.when((t["fault"] != "b") & F.coalesce(F.array_contains("again", t["pos"]), F.lit(False)), "d").otherwise(t["fault"])
    groups = groups.withColumn("symbols", F.array_join(F.transform("turns", lambda t: F.concat(t["initial"], fault(t))), ""))
    groups = groups.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    groups = checkpointed(groups.select("conv", "block", "turns", "symbols"))

    # a first block that isn't full is a whole conversation
    whole = (F.col("block") == 0) & (F.size("turns") < BLOCK)
    one = groups.filter(whole).select("conv", "block", "turns", _solved("symbols").alias("s")).select("conv", "block", "turns", "s.*")
    longer = groups.filter(~whole)
    edges = longer.select("conv", "block", "symbols", _borders("symbols").alias("edges")).repartition("conv").sortWithinPartitions("conv", "block")
    parts = checkpointed(edges.mapInArrow(*_chained(groups.schema["conv"])))
    many = longer.select("conv", "block", "turns").alias("a").join(parts.alias("b"), same("a", "b", "block")).select("a.conv", "a.block", "a.turns", *[f"b.{c}" for c in SOLVED.names])
    lines = F.flatten(F.transform(F.arrays_zip("turns", "codes"), lambda z: _pieces(z["turns"], z["codes"])))
    text = F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
    counts = ["cost", "blank", "duplicate", "truncated", "illegal"]
    short = one.select("conv", "audit", *counts, F.sha2(F.coalesce(text, F.lit("")), 256).alias("repaired_sha256"))
    texts = many.select("conv", "block", text.alias("text")).filter("text IS NOT NULL")
    hashes = sha256_in_order(texts, ["conv"], "block", "text", "repaired_sha256", "\n")
    sums = many.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"), *[F.sum(c).alias(c) for c in counts])
    long = sums.alias("a").join(hashes.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")), "left").select("a.*", F.coalesce("b.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    done = short.unionByName(long)

    turns = rows.groupBy("conv", "turn").agg(F.bool_and("lost").alias("lost"))
    here = F.when(~F.col("lost"), F.col("turn"))
    gaps = turns.groupBy("conv").agg(F.coalesce(F.max(here) - F.min(here) + 1 - F.count(here), F.lit(0)).cast("long").alias("gaps"))
    out = gaps.alias("a").join(done.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")), "left")
    zero = [F.coalesce(f"b.{c}", F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("a.conv", "a.gaps", *zero, F.coalesce("b.audit", F.lit("")).alias("audit"), F.coalesce("b.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
