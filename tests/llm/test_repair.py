"""Structure repair against a plain layer-by-layer search, and what its lattice promises."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from pathlake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def relaxed(best):
    for _ in range(4):
        for s, (c, a) in list(best.items()):
            for i in "ua":
                t, new = NEXT[s].get(i), (c + 2, a + "I")
                if t is not None and (t not in best or new < best[t]):
                    best[t] = new
    return best


def cheapest(symbols):
    best = relaxed({0: (0, "")})
    for initial, fault in symbols:
        ways = collections.defaultdict(list)
        for s, (c, a) in best.items():
            ways[s].append((c + 3, a + "D"))
            if fault not in "bd":
                if initial in NEXT[s]:
                    ways[NEXT[s][initial]].append((c + (fault == "t"), a + "K"))
                for o in "ua":
                    if o in NEXT[s]:
                        ways[NEXT[s][o]].append((c + 2 + (fault == "t"), a + "R"))
        best = relaxed({s: min(w) for s, w in ways.items()})
    return min(best[s] for s in (0, 3) if s in best)


def plain(rows):
    conv = {}
    for c, t, r, x in rows:
        turns = conv.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        turns += [((t is not None, t or 0), "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, turns in conv.items():
        turns.sort()
        seen, symbols = set(), []
        for _, r, x in turns:
            bare = x.rstrip(WHITE)
            fault = "b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((r, x))
            symbols.append((r[:1] if r[:1] in ("s", "u", "a") else "-", fault))
        cost, audit = cheapest(symbols)
        lines, i, state = [], 0, 0
        for edit in audit:
            new = "a" if state == 2 else "u"
            if edit == "I":
                lines.append({"u": "user:", "a": "assistant:"}[new])
                state = NEXT[state][new]
                continue
            _, r, x = turns[i]
            i += 1
            if edit == "D":
                continue
            new = r[0] if edit == "K" else new
            state = NEXT[state][new]
            lines.append(f"{r}:{x}" if edit == "K" else f"{ {'u': 'user', 'a': 'assistant'}[new]}:{x}")
        initials = "".join(s for s, _ in symbols)
        assert re.fullmatch("(s?(ua)+)?", "".join(w[0] for w in lines))
        known = [t for (there, t), _, _ in turns if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(initials[j : j + 2] not in ("su", "ua", "au") for j in range(len(initials) - 1))
        out.append((c, gaps, *[sum(f == q for _, f in symbols) for q in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in repair.repaired(repair.damaged(df)).collect()), key=str)


def test_search_finds_the_cheapest_edits_of_all():
    """Every sequence of up to four turns, against every sequence of edits with at most two inserts between turns."""

    def ways(symbols, state=0, i=0, inserted=0):
        if i == len(symbols) and state in (0, 3):
            yield 0, ""
        if inserted < 2:
            for o in "ua":
                if o in NEXT[state]:
                    yield from ((c + 2, "I" + a) for c, a in ways(symbols, NEXT[state][o], i, inserted + 1))
        if i < len(symbols):
            initial, fault = symbols[i]
            yield from ((c + 3, "D" + a) for c, a in ways(symbols, state, i + 1))
            if fault not in "bd":
                if initial in NEXT[state]:
                    yield from ((c + (fault == "t"), "K" + a) for c, a in ways(symbols, NEXT[state][initial], i + 1))
                for o in "ua":
                    if o in NEXT[state]:
                        yield from ((c + 2 + (fault == "t"), "R" + a) for c, a in ways(symbols, NEXT[state][o], i + 1))

    turns = list(itertools.product("sua-", "-t")) + [("u", "b")]
    for n in range(4):
        for symbols in itertools.product(turns, repeat=n):
            assert repair.search("".join(map("".join, symbols)))[:2] == min(ways(symbols)) == cheapest(symbols)


@pytest.mark.parametrize("block", [64, 2])
def test_against_a_plain_search(spark, monkeypatch, block):
    """Nulls, ties, repeated rows, roles outside the grammar, clashing columns; blocks of 2 cut every conversation."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rnd = random.Random(5)
    rows = []
    for c in range(-3, 40):
        texts = ["a", "b.", "", "é?\n", None, "c", "d", "e", "f."]
        for t in range(rnd.choice([0, 1, 2, 5, 12, 63, 64, 65, 130, 300])):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice([*texts, *[f"{t}."] * 8])))
    rows += [(None, i, "user", "x") for i in range(70)] + [(7000, i, "user", "same.") for i in range(3000)]
    rows += [(7001, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(2000)] + [(9000, 4, "user", "x" * 1_000_000 + " ")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS block", "3 AS `conv.x`", "4 AS lost").repartition(6)
    assert got(df) == plain(rows)


def test_all_rows_lost(spark):
    lost = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = got(spark.createDataFrame([(1, lost, "user", "x.")], SCHEMA))
    assert row == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
