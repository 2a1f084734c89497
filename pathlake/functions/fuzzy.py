"""Fuzzy matching: an ordered subsequence, found greedily from the left, and its score."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlake.functions.paths import ascii_lower
from pathlake.plans.patterns import java_quote
from pathlake.schema import FUZZY_CHAR, FUZZY_GAP_MAX, FUZZY_LENGTH_MAX, FUZZY_NEXT, FUZZY_START, WORD_BREAKS


def _fold(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def matches(target: Column, needle: str, case_sensitive: bool = False) -> Column:
    """Whether the needle's characters stand in target in order. One pattern, no score."""
    if not needle:
        return F.lit(True)
    if not case_sensitive:
        needle, target = _fold(needle), ascii_lower(target)
    return target.rlike("(?s)" + ".*?".join(java_quote(c) for c in needle))


def score(target: Column, needle: str, case_sensitive: bool = False) -> Column:
    """The score as an int, null where the needle doesn't match, 0 for an empty needle.

    The needle is a literal, so the fold over it is unrolled here: each step looks for one character with `locate`
    after the last one found, and no array of characters is built.
    """
    if not needle:
        return F.lit(0)
    hay = target if case_sensitive else ascii_lower(target)
    want = needle if case_sensitive else _fold(needle)
    last, total = F.lit(0), F.lit(0)  # position (from 1) of the last character found; points so far
    steps = F.struct(last.alias("at"), total.alias("sum"))
    chars = F.array(*[F.lit(c) for c in want])

    def step(acc: Column, c: Column) -> Column:
        at = F.call_function("locate", c, hay, acc["at"] + 1)
        before, here = F.substring(target, at - 1, 1), F.substring(target, at, 1)
        starts = (at == 1) | (F.instr(F.lit(WORD_BREAKS), before) > 0) | (before.rlike("^[a-z]$") & here.rlike("^[A-Z]$"))
        gap = F.when(acc["at"] == 0, 0).when(at == acc["at"] + 1, FUZZY_NEXT).otherwise(-F.least(at - acc["at"] - 1, F.lit(FUZZY_GAP_MAX)))
        points = F.lit(FUZZY_CHAR) + gap + F.when(starts, FUZZY_START).otherwise(0)
        lost = (acc["at"] < 0) | (at == 0)
        return F.struct(F.when(lost, -1).otherwise(at).alias("at"), F.when(lost, 0).otherwise(acc["sum"] + points).alias("sum"))

    length = F.least(F.floor(F.char_length(target) / 16).cast("int"), F.lit(FUZZY_LENGTH_MAX))
    return F.aggregate(chars, steps, step, lambda acc: F.when(acc["at"] > 0, acc["sum"] - length))
