"""Command line: analyze, advise, fingerprint, parse, rules, generate, version.

Exit codes: 0 done, 1 failed, 2 findings at or above ``--fail-on``, 64 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .advice.rules import SEVERITIES

DONE, FAILED, FOUND, USAGE = 0, 1, 2, 64


class _Arguments(argparse.ArgumentParser):
    def error(self, message):
        print(f"{self.prog}: {message}", file=sys.stderr)
        raise SystemExit(USAGE)


def _parser() -> argparse.ArgumentParser:
    top = _Arguments(prog="tidemark", description="Query-log analytics")
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Arguments)
    a = commands.add_parser("analyze", help="profile a log and advise on its costliest statements")
    a.add_argument("path")
    a.add_argument("--schema", help="file with the database's DDL")
    a.add_argument("--top", type=int, default=20)
    a.add_argument("--sort", default="time")
    a.add_argument("--database", default="")
    a.add_argument("--format", default="text")
    a.add_argument("--min-severity", default="info", choices=SEVERITIES)
    a.add_argument("--disable", action="append", default=[])
    a.add_argument("--no-advice", action="store_true")
    a.add_argument("--fail-on", choices=SEVERITIES)
    a.add_argument("--split-bytes", type=int, default=64 << 20)
    d = commands.add_parser("advise", help="advise on one statement")
    d.add_argument("sql", nargs="*")
    d.add_argument("--schema")
    d.add_argument("--json", action="store_true")
    d.add_argument("--disable", action="append", default=[])
    d.add_argument("--fail-on", choices=SEVERITIES)
    for name in ("fingerprint", "parse"):
        commands.add_parser(name).add_argument("sql", nargs="*")
    commands.add_parser("rules")
    g = commands.add_parser("generate", help="write a synthetic log")
    g.add_argument("path")
    g.add_argument("--events", type=int, default=10_000)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--plain", action="store_true", help="without extra fields")
    commands.add_parser("version")
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _received(session) -> str:
    """Standard input, copied block by block to a file that the executors can read."""
    from .sources.scratch import scratch_folder
    from .sources.slowlog import filesystem

    path = scratch_folder(session, "input")
    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/slow.log", compression=None) as out:
        while block := sys.stdin.buffer.read(1 << 20):
            out.write(block)
    return f"{path}/slow.log"


def _reached(severities, least: str | None) -> int:
    return FOUND if least and any(SEVERITIES.index(s) >= SEVERITIES.index(least) for s in severities) else DONE


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return _run(args)
    except (OSError, ValueError) as e:
        print(f"tidemark: {e}", file=sys.stderr)
        return FAILED


def _run(args) -> int:
    from . import api
    from .operators.render import findings_json, findings_text, render

    schema = open(args.schema, encoding="utf-8").read() if getattr(args, "schema", None) else None
    sql = " ".join(args.sql) or sys.stdin.read() if hasattr(args, "sql") else ""
    if args.command == "analyze":
        options = api.Options(args.top, args.sort, args.database, args.min_severity, tuple(args.disable), not args.no_advice)
        session = _session()
        path = _received(session) if args.path == "-" else args.path
        report = api.analyze_file(session, path, schema, options, args.split_bytes)
        report.run["source"] = args.path
        print(render(report, args.format), end="")
        return _reached((f.severity for c in report.classes for f in c.findings), args.fail_on)
    if args.command == "advise":
        catalog = api.SchemaCatalog.from_ddl(schema) if schema else None
        found = api.Engine(tuple(args.disable)).advise(sql, catalog)
        print(findings_json(found) if args.json else "\n".join(findings_text(found)) or "no findings")
        return _reached((f.severity for f in found), args.fail_on)
    if args.command == "fingerprint":
        print(json.dumps(api.fingerprint(sql)._asdict(), ensure_ascii=False))
    elif args.command == "parse":
        print(api.parse_tree(sql))
    elif args.command == "rules":
        for row in api.rules():
            print("{}  {:<26} {:<9} {}".format(*row))
    elif args.command == "generate":
        api.generate_log(_session(), args.path, args.events, args.seed, not args.plain)
    else:
        print(__version__)
    return DONE


if __name__ == "__main__":
    sys.exit(main())
