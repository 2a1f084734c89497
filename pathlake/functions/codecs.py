"""Text codecs: percent-encoded paths, octal escapes of mount tables, tags, file URIs, shell quoting."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~/")


def encode_path(path: str) -> str:
    return "".join(chr(b) if b in UNRESERVED else f"%{b:02X}" for b in path.encode("utf-8", "surrogateescape"))


def decode_path(text: str) -> str:
    """The inverse; a "%" without two hex digits stays."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "replace")


def encode_path_column(path: Column) -> Column:
    """encode_path with built-in functions: form encoding, put right where it differs."""
    out = F.url_encode(path)
    for wrong, right in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def octal_unescape(text: str) -> str:
    r"""`\040` and the like as bytes; any other backslash stays."""
    raw = re.sub(rb"\\([0-3][0-7]{2})", lambda m: bytes([int(m[1], 8)]), text.encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "replace")


def decode_path_column(text: Column) -> Column:
    """decode_path with built-in functions: what form decoding reads otherwise (a plus, a "%" without two hex digits) is encoded first."""
    return F.url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


@F.pandas_udf(T.StringType())
def octal_unescape_udf(texts: pd.Series) -> pd.Series:
    return texts.map(octal_unescape, na_action="ignore")


def clean_tag(tag: Column) -> Column:
    """A tag without space and leading "#"s; null if nothing is left or it has control characters."""
    t = F.trim(F.regexp_replace(F.trim(tag), r"^#+", ""))
    return F.when((t != "") & ~t.rlike(r"\p{Cntrl}"), t)


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), encode_path_column(path))


def shell_quote(path: Column) -> Column:
    """The path as one shell word; left alone if it needs no quotes."""
    quoted = F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(path.rlike(r"^[A-Za-z0-9@%+=:,./_-]+\z"), path).otherwise(quoted)


def shell_quote_text(path: str) -> str:
    return shlex.quote(path)


#: Offset and prime of the 64-bit FNV-1a hash; the prime is 2^40 + 0x1B3.
FNV_OFFSET, FNV_LOW = 0xCBF29CE484222325, 0x1B3
MASK32 = 0xFFFFFFFF


def path_hash(path: Column) -> Column:
    """FNV-1a of a path's bytes as 16 hex digits. In two halves of 32 bits, as products of 64 bits would overflow."""
    low = lambda x: x.bitwiseAND(F.lit(MASK32))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(path)), lambda i: F.conv(F.substring(F.hex(F.encode(path, "utf-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))

    def step(h, byte):
        lo = h["lo"].bitwiseXOR(byte)
        product = lo * F.lit(FNV_LOW)
        hi = h["hi"] * F.lit(FNV_LOW) + F.shiftright(product, 32) + F.shiftleft(lo, 8)
        return F.struct(low(hi).alias("hi"), low(product).alias("lo"))

    begin = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & MASK32).cast("long").alias("lo"))
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(F.when(F.octet_length(path) > 0, codes).otherwise(F.array().cast("array<bigint>")), begin, step, lambda h: F.concat(half(h["hi"]), half(h["lo"])))


def spool_name(path: Column) -> Column:
    """The name under which a path's extracted text is kept."""
    return F.concat(path_hash(path), F.lit(".txt"))


def local_time(seconds: Column) -> Column:
    """Epoch seconds in the session's time zone, as YYYY-MM-DDTHH:MM:SS."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
