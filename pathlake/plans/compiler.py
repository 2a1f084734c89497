"""Compiles a query into one predicate over the catalog. Pure: needs no session.

Conjuncts come cheapest first: those that Parquet statistics can prune, then flags, then names, then patterns. `now` is read
once a query and is a literal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlake.functions import categories, fuzzy, paths
from pathlake.plans.patterns import glob_term, regex_term
from pathlake.plans.query import Category, Query, QueryError, parse_tokens


@dataclass(frozen=True)
class Term:
    """A pattern of a query: kind is glob, regex or fuzzy."""

    kind: str
    text: str

    def on(self, target: Column, case_sensitive: bool) -> Column:
        make = {"glob": glob_term, "regex": regex_term}.get(self.kind)
        return make(target, self.text, case_sensitive) if make else fuzzy.matches(target, self.text, case_sensitive)


def _term(text: str, query: Query, is_fuzzy: bool) -> Term:
    t = Term("regex" if query.regex_mode else "fuzzy" if is_fuzzy else "glob", text)
    t.on(F.lit(""), query.case_sensitive)  # a pattern that doesn't compile is an error of the query
    return t


@dataclass
class Compiled:
    query: Query
    groups: list[list[Term]]  # all of these, any of each
    excludes: list[Term]
    folder: Term | None
    extensions: list[str]
    min_size: int | None
    max_size: int | None
    modified_within_secs: int | None
    under: str | None
    include_dirs: bool
    limit: int
    now: int

    @property
    def has_name_filter(self) -> bool:
        return bool(self.groups or self.excludes or self.folder)

    def target(self) -> Column:
        if self.query.full_path:
            return F.col("path")
        return F.when(F.col("name") == "", F.col("path")).otherwise(F.col("name"))

    def _each(self, columns: list[Column]) -> Column:
        return reduce(and_, columns) if columns else F.lit(True)

    def coarse(self, files_only: bool = False) -> Column:
        """All but names and content: what a scan can prune."""
        c, out = F.col, []
        sized = self.min_size is not None or self.max_size is not None
        if files_only or not self.include_dirs or self.extensions or sized:
            out.append(~c("is_dir"))
        if self.extensions:
            out.append(c("ext").isin(self.extensions))
        if self.min_size is not None:
            out.append(c("size") >= F.lit(self.min_size))
        if self.max_size is not None:
            out.append(c("size") <= F.lit(self.max_size))
        if self.modified_within_secs is not None:
            out.append(c("mtime") >= F.lit(self.now - self.modified_within_secs))
        if self.under is not None:
            out.append(paths.under(c("path"), self.under))
        if not self.query.include_hidden:
            out.append(~c("is_hidden"))
        if self.query.category.kind != "All":
            out.append(categories.predicate(self.query.category, self.now))
        return self._each(out)

    def names(self) -> Column:
        """Folder, every group and no exclusion."""
        cs, target, out = self.query.case_sensitive, self.target(), []
        if self.folder:
            out.append(self.folder.on(F.col("parent_name"), cs))
        out += [reduce(or_, [t.on(target, cs) for t in g]) for g in self.groups]
        out += [~t.on(target, cs) for t in self.excludes]
        return self._each(out)

    def predicate(self, files_only: bool = False) -> Column:
        return self.coarse(files_only) & self.names() if self.has_name_filter else self.coarse(files_only)

    def content(self, text: Column | None = None) -> Column:
        """Whether a text has the content pattern. Line by line: a newline at the end begins no line, and an empty text has none."""
        text = F.col("text") if text is None else text
        text = F.substring_index(text, "\0", 1)  # binary files are read up to the first NUL
        q = self.query
        if q.multiline:
            return (F.length(text) > 0) & regex_term(text, q.content, q.case_sensitive, multiline=True)
        lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
        return (F.length(text) > 0) & F.exists(lines, lambda line: regex_term(line, q.content, q.case_sensitive))

    def match_count(self) -> Column:
        """How many of the query's positive terms a row satisfies."""
        hits = [reduce(or_, [t.on(self.target(), self.query.case_sensitive) for t in g]).cast("int") for g in self.groups]
        return reduce(lambda a, b: a + b, hits) if hits else F.lit(0)

    def fuzzy_score(self) -> Column:
        """Over groups, the best alternative's score, summed; null where a group has none."""
        best = [F.greatest(*s, F.lit(None).cast("int")) if len(s := [fuzzy.score(self.target(), t.text, self.query.case_sensitive) for t in g]) > 1 else s[0] for g in self.groups]
        return reduce(lambda a, b: a + b, best) if best else F.lit(0)

    def relevance(self) -> Column:
        """0 to 100: exact name over prefix over substring over path alone, shorter names first. The weights are our own."""
        if not self.groups:
            return F.lit(100)
        name, path = paths.ascii_lower(F.col("name")), paths.ascii_lower(F.col("path"))
        best = F.lit(0)
        for g in self.groups:
            for t in g:
                word = t.text.lower()
                best = F.greatest(
                    best,
                    F.when(name == word, 100)
                    .when(name.startswith(word), 80 - F.least(F.char_length("name") - len(word), F.lit(19)))
                    .when(name.contains(word), 60 - F.least(F.char_length("name") - len(word), F.lit(19)))
                    .when(path.contains(word), 20)
                    .otherwise(F.when(t.on(self.target(), self.query.case_sensitive), 30).otherwise(0)),
                )
        return best.cast("int")


def compile_query(query: Query, now: int) -> Compiled:
    kept, tokens = parse_tokens(query.name)
    groups, excludes = [], []
    for raw, quoted in kept:
        negative, text = raw.startswith("!"), raw.removeprefix("!")
        if not text:
            continue
        if negative:
            excludes.append(_term(text, query, False))
            continue
        parts = [text] if query.regex_mode or quoted else [p for p in text.split("|") if p]
        if parts:
            groups.append([_term(p, query, query.fuzzy) for p in parts])
    extensions = []
    for raw in tokens.extensions or query.extensions:
        e = raw.strip().removeprefix(".")
        e = "".join(c.lower() if c.isascii() else c for c in e)
        if e and e not in extensions:
            extensions.append(e)
    least = tokens.min_size if tokens.min_size is not None else query.min_size
    most = tokens.max_size if tokens.max_size is not None else query.max_size
    if least is not None and most is not None and least > most:
        raise QueryError(f"min_size ({least} bytes) is greater than max_size ({most} bytes)")
    if query.content is not None:
        regex_term(F.lit(""), query.content, query.case_sensitive, query.multiline)
    age = tokens.modified_within_secs if tokens.modified_within_secs is not None else query.modified_within_secs
    return Compiled(
        query=query,
        groups=groups,
        excludes=excludes,
        folder=_term(tokens.folder, query, False) if tokens.folder else None,
        extensions=extensions,
        min_size=least,
        max_size=most,
        modified_within_secs=age,
        under=tokens.under or query.under,
        include_dirs=query.include_dirs and not tokens.files_only,
        limit=max(1, query.limit),
        now=now,
    )


__all__ = ["Category", "Compiled", "Query", "QueryError", "Term", "compile_query"]
