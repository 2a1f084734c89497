"""Terms of a query as Columns: substrings, globs and regular expressions.

Globs become the cheapest predicate that means the same: equality, prefix, suffix or substring, which Parquet
and codegen know, and a regular expression only for the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlake.functions.paths import ascii_lower


class PatternError(ValueError):
    """A pattern that doesn't compile."""


def java_quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|&~#\-])", r"\\\1", text)


def _class(glob: str, at: int) -> tuple[str, int]:
    """A character class from its "[" on, as a regular expression; and where it ends."""
    i = at + 1
    negated = glob[i : i + 1] in ("!", "^")
    i += negated
    body, first = "", True
    while i < len(glob) and (glob[i] != "]" or first):
        c = glob[i]
        if glob[i + 1 : i + 2] == "-" and glob[i + 2 : i + 3] not in ("", "]"):
            if c > glob[i + 2]:
                raise PatternError(f"invalid range {c}-{glob[i + 2]} in {glob!r}")
            body += f"{java_quote(c)}-{java_quote(glob[i + 2])}"
            i += 3
        else:
            body += java_quote(c)
            i += 1
        first = False
    if i >= len(glob):
        raise PatternError(f"unclosed character class in {glob!r}")
    return f"[{'^' * negated}{body}]", i + 1


def glob_regex(glob: str) -> str:
    """The body of a regular expression for the whole of what a glob matches; "*" and "?" match slashes too."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            part, i = _class(glob, i)
            out += part
            continue
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "}":
            raise PatternError(f"unopened alternation in {glob!r}")
        elif c == "," and depth:
            out += "|"
        elif c == "\\":
            i += 1
            if i >= len(glob):
                raise PatternError(f"dangling escape in {glob!r}")
            out += java_quote(glob[i])
        else:
            out += java_quote(c)
        i += 1
    if depth:
        raise PatternError(f"unclosed alternation in {glob!r}")
    return out


def glob_term(target: Column, term: str, case_sensitive: bool) -> Column:
    """A term of a query that isn't a regular expression: a glob over the whole target if it has `*`, `?` or `[`, else a substring (where `{a,b}` still alternates)."""
    glob = term if re.search(r"[*?\[]", term) else f"*{term}*"
    if not re.search(r"[?\[{}\\]", glob):  # stars and literals alone
        parts = re.split(r"\*+", glob)
        if not case_sensitive:
            target = ascii_lower(target)
            parts = [re.sub("[A-Z]", lambda m: m[0].lower(), p) for p in parts]
        if len(parts) == 1:
            return target == parts[0]
        if not any(parts):
            return F.lit(True)
        if len(parts) == 2 and not (parts[0] and parts[1]):
            return target.startswith(parts[0]) if parts[0] else target.endswith(parts[1])
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return target.contains(parts[1])
    return target.rlike(f"(?s{'' if case_sensitive else 'i'})^(?:{glob_regex(glob)})\\z")


#: Constructs that a linear-time dialect doesn't have, and that therefore are errors.
_REFUSED = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")


def regex_body(pattern: str, multiline: bool = False) -> str:
    """A pattern of the query language as a Java regular expression.

    Classes like \\d are Unicode and "." leaves out newlines alone; outside classes "$" means the end of the text (or of a line, if
    multiline). Look-around, back-references and possessive or atomic groups are refused.
    """
    bare = re.sub(r"\\\\", "", pattern)
    outside = re.sub(r"\[(?:\\.|[^\]\\])*\]", "", bare)
    if _REFUSED.search(outside):
        raise PatternError(f"invalid regex {pattern!r}: look-around, back-references and possessive groups are not supported")
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out += pattern[i : i + 2]
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out += "\\z" if c == "$" and not inside and not multiline else c
        i += 1
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\z", "x", out).replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!"))
    except re.error as e:
        raise PatternError(f"invalid regex {pattern!r}: {e}") from e
    return out


def regex_term(target: Column, pattern: str, case_sensitive: bool, multiline: bool = False) -> Column:
    """An unanchored search."""
    flags = "uUd" + ("" if case_sensitive else "i") + ("m" if multiline else "")
    return target.rlike(f"(?{flags}){regex_body(pattern, multiline)}")
