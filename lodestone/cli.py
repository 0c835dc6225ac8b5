"""The command line: index, query, stats."""

from __future__ import annotations

import datetime
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from lodestone import engine, output
from lodestone.functions.text import strip
from lodestone.operators.filters import Filters

OK, INVALID = 0, 2
DEFAULT_INDEX = "lodestone-index"
USAGE = """lodestone - index and query folders of Markdown pages

Usage:
  lodestone index [folder] [--db path] [--rebuild] [--json]
  lodestone query --q text [--db path] [--mode hybrid|lexical|vector] [--fusion weighted|rrf] [--offset N] [--limit N] [--json] [--explain]
  lodestone stats [--db path] [--json]

Indexing defaults to incremental mode; use --rebuild for full rebuild."""


class UsageError(ValueError):
    pass


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parse_index(args: list[str]) -> tuple[str, str, bool, bool]:
    """(folder, index path or '', rebuild, json), flags in any order."""
    folder, path, rebuild, as_json = ".", "", False, False
    it = iter([a for a in map(strip, args)])
    for a in it:
        if not a:
            continue
        if a == "--rebuild":
            rebuild = True
        elif a == "--json":
            as_json = True
        elif a == "--db" or a.startswith("--db="):
            value = next(it, None) if a == "--db" else a[5:]
            if value is None:
                raise UsageError("--db requires a value")
            path = strip(value)
            if not path:
                raise UsageError("--db requires a non-empty value")
        elif a.startswith("-"):
            raise UsageError(f"unknown flag {a}")
        elif folder != ".":
            raise UsageError("index accepts at most one folder argument")
        else:
            folder = a
    return folder, path, rebuild, as_json


_QUERY_FLAGS = {"db": DEFAULT_INDEX, "q": "", "mode": "hybrid", "fusion": "weighted", "alpha": 0.70, "rrf-k": 60, "top-k": 10, "offset": 0, "limit": 0, "candidate-k": 50, "space": "", "page-id": "", "from": "", "to": "", "expand": 0, "json": False, "explain": False}
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def parse_flags(args: list[str], flags: dict) -> tuple[dict, list[str]]:
    """Flags as -name value, --name value or --name=value (true or false ones stand alone), up to the first other argument or --."""
    found, i = dict(flags), 0
    while i < len(args):
        a = args[i]
        if len(a) < 2 or a[0] != "-":
            break
        i += 1
        if a == "--":
            break
        name, eq, value = a.lstrip("-").partition("=")
        if name not in flags or a.startswith("---"):
            raise UsageError(f"flag provided but not defined: -{name}")
        default = flags[name]
        if isinstance(default, bool):
            if eq and value not in _TRUE + _FALSE:
                raise UsageError(f'invalid boolean value "{value}" for -{name}')
            found[name] = not eq or value in _TRUE
            continue
        if not eq:
            if i >= len(args):
                raise UsageError(f"flag needs an argument: -{name}")
            value = args[i]
            i += 1
        try:
            found[name] = type(default)(value)
        except ValueError:
            raise UsageError(f'invalid value "{value}" for flag -{name}: parse error') from None
    return found, args[i:]


def _date(flag: str, value: str) -> datetime.date | None:
    value = strip(value)
    if not value:
        return None
    try:
        if len(value) != 10:
            raise ValueError
        return datetime.datetime.strptime(value, "%Y-%m-%d").date()
    except ValueError:
        raise UsageError(f"query {flag} must be YYYY-MM-DD") from None


def parse_query(args: list[str]) -> tuple[str, engine.Request, bool, bool]:
    """(index path, request, json, explain); stricter than the library, which replaces values out of range."""
    f, _ = parse_flags(args, _QUERY_FLAGS)
    checks = [
        (not f["q"], "query requires --q"), (not strip(f["db"]), "query requires a non-empty --db path"),
        (f["mode"] not in ("hybrid", "lexical", "vector"), "query --mode must be one of: hybrid, lexical, vector"), (f["fusion"] not in ("weighted", "rrf"), "query --fusion must be one of: weighted, rrf"),
        (not 0 <= f["alpha"] <= 1, "query --alpha must be between 0 and 1"), (f["rrf-k"] <= 0, "query --rrf-k must be > 0"), (f["top-k"] <= 0, "query --top-k must be > 0"),
        (f["offset"] < 0, "query --offset must be >= 0"), (f["limit"] < 0, "query --limit must be >= 0"), (f["candidate-k"] <= 0, "query --candidate-k must be > 0"), (f["expand"] < 0, "query --expand must be >= 0"),
    ]
    for wrong, message in checks:
        if wrong:
            raise UsageError(message)
    start, end = _date("--from", f["from"]), _date("--to", f["to"])
    if start and end and start > end:
        raise UsageError("query date range invalid: --from must be <= --to")
    request = engine.Request(f["q"], f["mode"], f["fusion"], f["alpha"], f["rrf-k"], f["top-k"], f["offset"], f["limit"], f["candidate-k"], f["expand"], Filters(f["space"], f["page-id"], f["from"], f["to"]))
    return f["db"], request, f["json"], f["explain"]


def run_index(args: list[str], spark: Callable[[], SparkSession]) -> str:
    try:
        folder, path, rebuild, as_json = parse_index(args)
        path = os.path.abspath(path) if path else os.path.join(os.path.abspath(folder), DEFAULT_INDEX)
        response = engine.index(spark(), folder, path, rebuild)
    except (UsageError, engine.IndexError_, engine.StoreError) as error:
        raise UsageError(f"index: {error}") from error
    return output.index_json(response) if as_json else output.index_text(response)


def run_query(args: list[str], spark: Callable[[], SparkSession]) -> str:
    path, request, as_json, explained = parse_query(args)
    try:
        response = engine.query(spark(), path, request)
    except (engine.QueryError, engine.StoreError) as error:
        raise UsageError(f"query: {error}") from error
    return output.query_json(path, request, response, explained) if as_json else output.query_text(request, response, explained)


def run_stats(args: list[str], spark: Callable[[], SparkSession]) -> str:
    f, rest = parse_flags(args, {"db": DEFAULT_INDEX, "json": False})
    if rest:
        raise UsageError("stats does not accept positional arguments")
    if not strip(f["db"]):
        raise UsageError("stats requires a non-empty --db path")
    try:
        found = engine.stats(spark(), f["db"])
    except engine.StoreError as error:
        raise UsageError(f"stats: {error}") from error
    return output.stats_json(f["db"], found) if f["json"] else output.stats_text(f["db"], found)


def main(args: list[str] | None = None, spark: Callable[[], SparkSession] = session) -> int:
    args = sys.argv[1:] if args is None else args
    commands = {"index": run_index, "query": run_query, "stats": run_stats}
    if args and args[0] in ("help", "-h", "--help"):
        print(USAGE)
        return OK
    if not args or args[0] not in commands:
        if args:
            print(f"unknown command: {args[0]}\n", file=sys.stderr)
        print(USAGE, file=sys.stderr)
        return INVALID
    try:
        print(commands[args[0]](args[1:], spark))
        return OK
    except UsageError as error:
        print(error, file=sys.stderr)
        return INVALID
