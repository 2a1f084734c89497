"""The query record, its JSON form, and the parsing of query text."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pathlake.schema import AGE_WORDS, DEFAULT_LIMIT

UNITS = {"tb": 1 << 40, "gb": 1 << 30, "mb": 1 << 20, "kb": 1 << 10, "b": 1}
CATEGORIES = ("All", "Recent", "Images", "Docs", "Code", "Archives", "Audio", "Video", "Large")


class QueryError(ValueError):
    """A query that cannot be run as it stands."""


@dataclass(frozen=True)
class Category:
    """`All`, one of the extension categories, `Recent` (param: greatest age in seconds) or `Large` (param: least size in bytes)."""

    kind: str = "All"
    param: int | None = None

    def to_json(self):
        if self.kind == "Recent":
            return {"Recent": {"max_age_secs": self.param}}
        return {"Large": {"min_bytes": self.param}} if self.kind == "Large" else self.kind

    @classmethod
    def from_json(cls, value) -> Category:
        if isinstance(value, dict) and len(value) == 1:
            kind, params = next(iter(value.items()))
            name = {"Recent": "max_age_secs", "Large": "min_bytes"}.get(kind)
            if name and isinstance(params, dict) and name in params:
                return cls(kind, int(params[name]))
        elif isinstance(value, str) and value in CATEGORIES and value not in ("Recent", "Large"):
            return cls(value)
        raise QueryError(f"unknown category {value!r}")


@dataclass
class Query:
    name: str = ""
    regex_mode: bool = False
    case_sensitive: bool = False
    include_hidden: bool = False
    full_path: bool = False
    content: str | None = None
    category: Category = field(default_factory=Category)
    include_dirs: bool = True
    under: str | None = None
    extensions: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    modified_within_secs: int | None = None
    fuzzy: bool = False
    multiline: bool = False
    content_or_name: bool = False
    limit: int = DEFAULT_LIMIT

    REQUIRED = ("name", "regex_mode", "case_sensitive", "include_hidden", "full_path", "category", "include_dirs", "limit")

    def to_json(self) -> str:
        return json.dumps({**{k: getattr(self, k) for k in self.__dataclass_fields__}, "category": self.category.to_json()})

    @classmethod
    def from_json(cls, text: str) -> Query:
        """Fields that came later may be missing and have their defaults; unknown fields are ignored."""
        data = json.loads(text)
        if missing := [k for k in cls.REQUIRED if k not in data]:
            raise QueryError(f"missing field {missing[0]}")
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__}
        return cls(**{**known, "category": Category.from_json(known["category"])})


def split_terms(text: str) -> list[tuple[str, bool]]:
    """(term, quoted): split at white space outside double quotes. A quote anywhere marks the whole term; one that never closes is accepted."""
    out, term, quoted, inside = [], "", False, False
    for c in text:
        if c == '"':
            inside, quoted = not inside, True
        elif c.isspace() and not inside:
            if term or quoted:
                out.append((term, quoted))
            term, quoted = "", False
        else:
            term += c
    if term or quoted:
        out.append((term, quoted))
    return [(t, q) for t, q in out if t]


def parse_bytes(text: str) -> int | None:
    """`10B`, `2.5MB`, `7`: binary units, rounded half up; None if it is no size."""
    t = text.strip().lower()
    unit = next((u for u in UNITS if t.endswith(u)), "")
    try:
        value = float(t[: len(t) - len(unit)].strip())
    except ValueError:
        return None
    if not math.isfinite(value) or value < 0:
        return None
    return int(value * UNITS.get(unit, 1) + 0.5)


def parse_size(text: str) -> tuple[int | None, int | None] | None:
    """(least, most) of `a..b`, `>=a`, `<=a`, `>a`, `<a` or `a`; None if it is no size filter."""
    if ".." in text:
        lo, hi = (parse_bytes(x) if x else None for x in text.split("..", 1))
        bad = [x for x, v in zip(text.split("..", 1), (lo, hi)) if x and v is None]
        return None if bad or (lo is None and hi is None) else (lo, hi)
    for op, make in ((">=", lambda v: (v, None)), ("<=", lambda v: (None, v)), (">", lambda v: (v + 1, None)), ("<", lambda v: (None, max(0, v - 1)))):
        if text.startswith(op):
            v = parse_bytes(text[len(op) :])
            return None if v is None else make(v)
    v = parse_bytes(text)
    return None if v is None else (v, v)


def parse_age(text: str) -> int | None:
    """Seconds of `today`, `week`, `12h`, `3d`, `2w` and so on; None if it is no age."""
    t = text.strip().lower()
    if t in AGE_WORDS:
        return AGE_WORDS[t]
    m = re.fullmatch(r"(\d+)([hdw])", t, re.A)
    return int(m[1]) * {"h": 3600, "d": 86_400, "w": 604_800}[m[2]] if m else None


@dataclass
class Tokens:
    extensions: list[str] = field(default_factory=list)
    min_size: int | None = None
    max_size: int | None = None
    modified_within_secs: int | None = None
    under: str | None = None
    folder: str | None = None
    files_only: bool = False


def parse_tokens(text: str) -> tuple[list[tuple[str, bool]], Tokens]:
    """The terms that are left, and what `key:value` tokens say. A value that doesn't parse leaves its token a term; quoted terms are never tokens."""
    kept, out = [], Tokens()
    for term, quoted in split_terms(text):
        key, colon, value = term.partition(":")
        taken = False
        if colon and not quoted:
            if key == "ext":
                out.extensions += [x for x in (p.strip().lstrip(".") for p in re.split("[,;]", value)) if x]
                taken = True
            elif key == "size" and (bounds := parse_size(value)):
                out.min_size, out.max_size = bounds
                taken = True
            elif key in ("modified", "mod", "date") and (age := parse_age(value)) is not None:
                out.modified_within_secs, taken = age, True
            elif key in ("in", "under") and value:
                out.under, taken = value, True
            elif key in ("folder", "parent") and value:
                out.folder, taken = value, True
            elif key in ("file", "files"):
                out.files_only, taken = True, True
                if value:
                    kept.append((value, False))
        if not taken:
            kept.append((term, quoted))
    return kept, out


def cli_size(text: str) -> int:
    """Sizes of the command line: an integer, with K, M or G."""
    m = re.fullmatch(r"\s*(\d+)([kmg]?)\s*", text, re.I | re.A)
    if not m or (v := int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]) >= 1 << 64:
        raise QueryError(f"invalid size {text!r}")
    return v


def cli_duration(text: str) -> int:
    """Durations of the command line, in seconds: an integer, with s, m, h, d or w."""
    m = re.fullmatch(r"\s*(\d+)([smhdw]?)\s*", text, re.I | re.A)
    if not m or (v := int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}[m[2].lower()]) >= 1 << 63:
        raise QueryError(f"invalid duration {text!r}")
    return v
