"""Command line: `python -m pathlake.cli search TERMS --catalog DIR`, and count, watch, status, rebuild, rescan, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from pathlake.config import Config
from pathlake.engine import Engine, handle
from pathlake.plans.patterns import PatternError
from pathlake.plans.query import Category, Query, QueryError, cli_duration, cli_size
from pathlake.schema import CLI_LIMIT
from pathlake.sources import export


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "count", "watch", "status", "rebuild", "rescan", "serve"):
        c = sub.add_parser(name)
        c.add_argument("--catalog", required=True)
        c.add_argument("--config")
        c.add_argument("--mounts", help="a mount table, such as /proc/self/mounts")
        if name in ("watch", "rescan"):
            c.add_argument("--interval", type=int, default=1 if name == "watch" else None)
            c.add_argument("--times", type=int, help="stop after so many; default: watch goes on, rescan does one")
        if name in ("search", "count", "watch"):
            c.add_argument("terms", nargs="*")
            c.add_argument("--content")
            for flag in ("regex", "case-sensitive", "hidden", "full-path", "files-only", "fuzzy", "multiline", "or", "json"):
                c.add_argument(f"--{flag}", action="store_true")
            c.add_argument("--ext", default="")
            c.add_argument("--min-size", type=cli_size)
            c.add_argument("--max-size", type=cli_size)
            c.add_argument("--modified-within", type=cli_duration)
            c.add_argument("--under")
            c.add_argument("--category", default="All")
            c.add_argument("--limit", type=int, default=CLI_LIMIT)
    return p


def query_of(a: argparse.Namespace) -> Query:
    return Query(
        name=" ".join(a.terms), regex_mode=a.regex, case_sensitive=a.case_sensitive, include_hidden=a.hidden, full_path=a.full_path, content=a.content,
        category=Category.from_json(a.category), include_dirs=not a.files_only, under=a.under, extensions=[e for e in a.ext.split(",") if e], min_size=a.min_size, max_size=a.max_size,
        modified_within_secs=a.modified_within, fuzzy=a.fuzzy, multiline=a.multiline, content_or_name=getattr(a, "or"), limit=a.limit,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = parser().parse_args(argv)
    out = out or sys.stdout
    spark = spark or SparkSession.builder.appName("pathlake").getOrCreate()
    engine = Engine(spark, a.catalog, Config.load(a.config) if a.config else Config().overridden(os.environ), a.mounts)
    try:
        if a.command == "search":
            found = engine.search(query_of(a))
            if a.json:
                print(export.envelope(found), file=out)
            else:
                for r in found.results.collect():  # at most the limit
                    print(r["path"], file=out)
                print(f"{found.indexed} files indexed, {found.elapsed_ms} ms{', truncated' * found.truncated}", file=sys.stderr)
        elif a.command == "watch":
            for rows in engine.watch(query_of(a), a.interval, a.times):
                for r in rows:
                    print(json.dumps(r.asDict(), ensure_ascii=False) if a.json else r["path"], file=out)
                out.flush()  # a reader sees each match as it appears
        elif a.command == "rescan":
            if a.interval is not None:
                engine.config = engine.config.patched({"rescan_interval_secs": a.interval})
                for n in engine.rescans(a.times):
                    print(n, file=out, flush=True)
            else:
                print(engine.rescan(), file=out)
        elif a.command == "count":
            print(engine.count(query_of(a)), file=out)
        elif a.command == "status":
            print(json.dumps(engine.status()), file=out)
        elif a.command == "rebuild":
            print(json.dumps(engine.rebuild()), file=out)
        else:
            for line in sys.stdin:
                print(handle(engine, line), file=out, flush=True)
    except (QueryError, PatternError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
