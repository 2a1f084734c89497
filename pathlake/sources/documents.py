"""Text of documents: plain files, DOCX, OpenDocument, PDF; as a pandas UDF over (extension, bytes)."""

from __future__ import annotations

import io
import os
import re
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlake.operators.search import small_side
from pathlake.sources.shared import checkpointed
from pathlake.schema import DOCUMENT_EXTENSIONS, PROBE, TEXT_MAX

#: Which elements hold text and which end lines or cells.
DOCX_TEXT, DOCX_LINES, DOCX_CELLS, DOCX_MARKS = {"t", "delText"}, {"p", "tr"}, {"tc"}, {"br": "\n", "cr": "\n", "tab": "\t"}
ODF_TEXT, ODF_LINES, ODF_CELLS, ODF_MARKS = {"p", "h", "list-item", "table-cell"}, {"p", "h", "list-item", "table-row"}, {"table-cell"}, {"line-break": "\n", "tab": "\t", "s": " "}
DOCX_PARTS = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml")


class TooLong(Exception):
    pass


def plain_text(data: bytes, most: int = TEXT_MAX) -> str | None:
    """A text file's text; None for one that is over the cap or has a NUL near its start."""
    return None if len(data) > most or b"\0" in data[:PROBE] else data.decode("utf-8", "replace")


def _markup(xml: bytes, holders: set, lines: set, cells: set, marks: dict, nested: bool, room: int) -> str:
    """Text of an XML part. nested: text counts anywhere inside a holder; else only directly in it."""
    out: list[str] = []
    size = depth = 0
    local = lambda n: n.split(":", 1)[-1]

    def put(s: str):
        nonlocal size
        out.append(s)
        size += len(s)
        if size > room:
            raise TooLong

    def start(name, _):
        nonlocal depth
        n = local(name)
        depth += n in holders
        if n in marks:
            put(marks[n])

    def end(name):
        nonlocal depth
        n = local(name)
        depth -= n in holders
        if n in cells:
            put("\t")
        if n in lines:
            put("\n")

    p = expat.ParserCreate()
    p.UseForeignDTD(True)
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda s: put(s) if depth else None
    p.SkippedEntityHandler = lambda name, is_param: put(" ") if depth and not is_param else None
    p.Parse(xml, True)
    return "".join(out)


def package_text(data: bytes, ext: str, most: int = TEXT_MAX) -> str | None:
    """Text of a DOCX or OpenDocument file; None for one that is damaged, without text or over the cap."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if ext == "docx":
                parts = [p for p in DOCX_PARTS if p in names] + sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
                rules = (DOCX_TEXT, DOCX_LINES, DOCX_CELLS, DOCX_MARKS, False)
            else:
                parts, rules = [p for p in ("content.xml",) if p in names], (ODF_TEXT, ODF_LINES, ODF_CELLS, ODF_MARKS, True)
            out, room = [], most
            for p in parts:
                with z.open(p) as f:
                    xml = f.read(8 * most + 1)
                if len(xml) > 8 * most:
                    return None
                out.append(_markup(xml, *rules, room))
                room -= len(out[-1])
    except (zipfile.BadZipFile, expat.ExpatError, TooLong, KeyError, OSError, zlib.error, RuntimeError, NotImplementedError, EOFError):
        return None
    text = "".join(out)
    return text if text.strip() else None


_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
#: What is shown, what ends a line, and which font is taken.
_SHOWN = re.compile(rb"(\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*\]\s*TJ|(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\"))|(T\*|Td|TD|ET|Tm)|/(\S+)\s+[-+.\d]+\s+Tf", re.S)
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)stream\r?\n(.*?)\r?\nendstream", re.S)
_REF = rb"\s*(\d+)\s+\d+\s+R"
_FONTS = re.compile(rb"/Font\s*(?:<<(.*?)>>|" + _REF.strip() + rb")", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(s: bytes) -> bytes:
    if s[:1] == b"<":
        h = re.sub(rb"\s", b"", s[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    one = lambda m: _ESCAPES.get(m[1], b"") or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1] if m[1] != b"\n" else b"")
    return re.sub(rb"\\([0-7]{1,3}|.)", one, s[1:-1], flags=re.S)


def _inflated(head: bytes, body: bytes, most: int) -> bytes | None:
    """A stream's bytes; None for a coding other than Flate, or one that is damaged."""
    if b"FlateDecode" not in head:
        return None if b"/Filter" in head else body
    try:
        return zlib.decompressobj().decompress(body, most)
    except zlib.error:
        return None


def _pdf_objects(data: bytes, most: int) -> dict[int, tuple[bytes, bytes | None]]:
    """{number: (dictionary, stream)} of all objects, those packed in object streams too; a later one of a number wins."""
    out = {}
    for m in _OBJECT.finditer(data):
        s = _STREAM.match(m[2])
        out[int(m[1])] = (s[1], _inflated(s[1], s[2], most)) if s else (m[2], None)
    for head, body in list(out.values()):
        first = re.search(rb"/First\s+(\d+)", head)
        if body is None or not first or not re.search(rb"/Type\s*/ObjStm", head):
            continue
        table = [int(x) for x in body[: int(first[1])].split() if x.isdigit()]
        starts = [int(first[1]) + x for x in table[1::2]]
        for number, lo, hi in zip(table[::2], starts, [*starts[1:], len(body)]):
            out.setdefault(number, (body[lo:hi], None))
    return out


def _unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code, {code: text}) of a font's ToUnicode table."""
    text = lambda h: bytes.fromhex(h[: len(h) // 4 * 4].decode()).decode("utf-16-be", "replace")
    out, width = {}, 1
    for part in re.finditer(rb"begin(bfchar|bfrange)(.*?)end", cmap, re.S):
        if part[1] == b"bfchar":
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4,})>", part[2]):
                out[int(code, 16)], width = text(to), max(width, len(code) // 2)
            continue
        for lo, hi, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]{4,})>|\[(.*?)\])", part[2], re.S):
            width = max(width, len(lo) // 2)
            first, count = int(lo, 16), min(int(hi, 16) - int(lo, 16) + 1, 1 << 16)
            if many:
                out |= {first + i: text(h) for i, h in enumerate(re.findall(rb"<([0-9A-Fa-f]{4,})>", many)[:count])}
            else:
                start = text(to)
                out |= {first + i: start[:-1] + chr(min(ord(start[-1]) + i, 0x10FFFF)) for i in range(count)}
    return width, out


def _font_maps(objects: dict) -> dict[bytes, tuple[int, dict[int, str]]]:
    """The ToUnicode tables by the names that pages give to fonts. Of one name on several pages with different fonts the last counts."""
    out = {}
    for head, _ in objects.values():
        for m in _FONTS.finditer(head):
            named = m[1] if m[1] is not None else objects.get(int(m[2]), (b"", None))[0]
            for name, number in re.findall(rb"/(\S+?)" + rb"\s+(\d+)\s+\d+\s+R", named):
                table = re.search(rb"/ToUnicode" + _REF, objects.get(int(number), (b"", None))[0])
                if table and (cmap := objects.get(int(table[1]), (b"", None))[1]):
                    out[name] = _unicode_map(cmap)
    return out


def _shown_text(raw: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if font:
        width, table = font
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def pdf_text(data: bytes, most: int = TEXT_MAX) -> str | None:
    """The text layer of a PDF: strings shown by its content streams, in their order, by the fonts' tables where they have any. Best effort: None where there is nothing to read."""
    if len(data) > 8 * most or not data.lstrip()[:5] == b"%PDF-":
        return None
    objects = _pdf_objects(data, 8 * most)
    fonts, out = _font_maps(objects), []
    for _, body in objects.values():
        if body is None or b"BT" not in body:
            continue
        font = None
        for shown in _SHOWN.finditer(body):
            if shown[1]:
                out += [_shown_text(_pdf_string(x[0]), font) for x in _STRING.finditer(shown[1])]
            elif shown[3]:
                font = fonts.get(shown[3])
            elif out and out[-1] != "\n":
                out.append("\n")
    text = "".join(out).strip()
    return text if text and len(text) <= most else None


def extract(ext: str, data: bytes | None, most: int = TEXT_MAX) -> str | None:
    """Text of a file by its extension."""
    if data is None:
        return None
    if ext == "pdf":
        return pdf_text(data, most)
    return package_text(data, ext, most) if ext in DOCUMENT_EXTENSIONS else plain_text(data, most)


@F.pandas_udf(T.StringType())
def extract_text(ext: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([extract(e or "", bytes(c) if c is not None else None) for e, c in zip(ext, content)], dtype=object)


def texts(spark: SparkSession, directory: str, most: int = TEXT_MAX) -> DataFrame:
    """(path, text) of all files under a directory; larger ones are not read."""
    from pathlake.functions import paths

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).filter(F.col("length") <= 8 * most)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "%20", " ")
    ext = paths.extension_of(paths.name_of(path))
    return f.select(path.alias("path"), extract_text(ext, "content").alias("text")).filter("text IS NOT NULL")


def read_live(wanted: DataFrame, most: int = TEXT_MAX) -> DataFrame:
    """(path, text) of the files that wanted (path) names, as they are now; those that cannot be read or hold no text are left out. Executors must see the files."""

    def run(batches):
        for rows in batches:
            out = []
            for path in rows["path"]:
                try:
                    if os.path.isfile(path) and os.path.getsize(path) <= 8 * most:
                        with open(path, "rb") as f:
                            ext = re.search(r"[^/]\.([^./]*)$", path)
                            out.append((path, extract(ext[1].lower() if ext else "", f.read(), most)))
                except OSError:
                    continue
            yield pd.DataFrame([x for x in out if x[1] is not None], columns=["path", "text"])

    return wanted.select("path").mapInPandas(run, "path string, text string")


def cached_or_live(candidates: DataFrame, cached: DataFrame, most: int = TEXT_MAX) -> DataFrame:
    """(path, text) of candidates: the text that is cached where there is one, else the file as it is now."""
    here = candidates.select("path")
    known = cached.select("path", "text").join(small_side(here), "path", "left_semi")
    return known.unionByName(read_live(here.join(cached.select("path"), "path", "left_anti"), most))


def within_cap(doc_text: DataFrame, cap: int, order: str = "seq", key: str = "path") -> DataFrame:
    """The newest texts that fit in `cap` bytes together, oldest out first: by `order` downwards, then by `key`, nulls last.

    Only sizes are sorted, by ranges side by side: sums of the ranges (a number a task) say in which one the cap is met, and a running sum over that one where.
    The texts are then filtered by that place, and neither sorted nor shuffled. Rows that are alike in order and key stay or go together. A null text has no bytes.
    """
    from pyspark.sql import Window

    seq, name = doc_text[f"`{order}`"], doc_text[f"`{key}`"]
    by = [F.col("s").desc_nulls_last(), F.col("k").asc_nulls_last()]
    sizes = doc_text.select(seq.alias("s"), name.alias("k"), F.coalesce(F.octet_length(doc_text["`text`"]), F.lit(0)).cast("long").alias("n")).groupBy("s", "k").agg(F.sum("n").alias("n"))
    at = checkpointed(sizes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = 0
    for r in at.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect():
        if before + r["n"] > cap:
            break
        before += r["n"]
    else:
        return doc_text
    run = at.filter(part == r["part"]).withColumn("run", before + F.sum("n").over(Window.orderBy("at")))
    out = run.filter(F.col("run") > cap).orderBy("at").first()  # the first that doesn't fit
    newer = F.coalesce(seq > F.lit(out["s"]), F.lit(out["s"] is None) & seq.isNotNull())
    earlier = F.coalesce(name < F.lit(out["k"]), F.lit(out["k"] is None) & name.isNotNull())
    return doc_text.filter(newer | (seq.eqNullSafe(F.lit(out["s"])) & earlier))
