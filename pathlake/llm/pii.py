"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, "://" and identifier cues); at each
anchor a local parser expands to both sides, validates and takes the span. Nothing else of the text is
looked at. The four base kinds are those that a leftmost non-overlapping search for their patterns
would give; url, account and secret are added.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.llm.common import field, spread

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Cue words before an account or identity number, and before a credential.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "password", "api_key", "apikey", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR_PARTS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[A-Za-z0-9\[][^\s<>\"'`{}|\\^]*")
ACCOUNT_REST = re.compile(r"[\s:#=.]{0,4}(?:(?:number|no|nr)[\s:#=.]{1,4})?([A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]){8,30}|[0-9](?:[\x20-]?[0-9]){5,19})(?![0-9A-Za-z])", re.I)
SECRET_REST = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_\-+/=.]{16,})")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("url", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, in code points, ordered by start, then kind as in KINDS."""
    out: list[tuple[int, str, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where each kind's last match ended; failed matches count
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at and text[at - 1] in DIGITS:
                continue
            if at >= done["ip"] and (m := FOUR_PARTS.match(text, at)):
                done["ip"] = m.end()
                if all(map(_part, m[0].split("."))):
                    out.append((at, "ip", m.end()))
            if at >= done["card"] and (m := CARD_RUN.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, "card", m.end()))
        elif kind == "at":
            s, floor = at, done["email"]
            while s > floor and text[s - 1] in LOCAL:
                s -= 1
            if s < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append((s, "email", m.end()))
        elif kind == "plus":
            if at >= done["phone"] and (m := PHONE_RUN.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((at, "phone", m.end()))
        elif kind == "url":
            s, floor = at, max(done["url"], at - 12)
            while s > floor and text[s - 1] in SCHEME:
                s -= 1
            if s < at and (m := URL_REST.match(text, last + 1)):
                e = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                if e > last + 1:
                    done["url"] = e
                    out.append((s, "url", e))
        else:
            if at and text[at - 1].isalnum():
                continue
            m = (ACCOUNT_REST if kind == "account" else SECRET_REST).match(text, last + 1)
            if m and m.start(1) >= done[kind]:
                done[kind] = m.end(1)
                out.append((m.start(1), kind, m.end(1)))
    out.sort(key=lambda x: (x[0], ORDER[x[1]]))
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row; null and empty texts have none.

    Whole texts are searched; repeated rows are searched each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in find(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], names=["doc_id", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return spread(rows).mapInArrow(run, T.StructType([field(rows, "doc_id"), T.StructField("spans", kind)]))


def joined(spans_col: str = "spans", only: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of these kinds, comma-joined in their order."""
    kept = F.filter(spans_col, lambda s: s["kind"].isin(*only)) if only != KINDS else F.col(spans_col)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """What the query returns of spans()."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    n = [count(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *n, F.sha2(joined(only=BASE), 256).alias("base_sha256"), joined().alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def mask(text: str) -> str:
    """text with every span replaced by its kind; of overlapping spans the one that starts first, then the longest, is taken."""
    out, at = [], 0
    for s, k, e in sorted(find(text), key=lambda x: (x[0], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join([*out, text[at:]])


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in find(text) if k in BASE).encode()).hexdigest()
