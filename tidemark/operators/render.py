"""Reports as text, JSON or Markdown."""

from __future__ import annotations

import json
import math
import re
import textwrap

from .. import __version__
from ..functions.formats import abbreviate, format_compact, format_count, format_duration
from .report import Report, label_of

BARS = "▁▂▃▄▅▆▇█"
STYLES = {"critical": "\x1b[1;31m", "warning": "\x1b[33m", "info": "\x1b[36m"}


def sparkline(counts: list[int]) -> str:
    """One bar per count, scaled to the largest; a blank for none."""
    most = max(counts, default=0)
    return "".join(" " if not n else BARS[min(7, n * 8 // (most + 1))] for n in counts)


def _clean(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, (list, tuple)) else value


#: Fixed values of the JSON format: the run's fields with what they hold where nothing is known, and the figures of a class.
RUN_FIELDS = {"source": "", "bytes": 0, "lines": 0, "skipped": 0, "filtered": 0, "threads": 0, "chunks": 0, "parse_seconds": 0.0, "elapsed_seconds": 0.0, "schema_tables": 0, "database_filter": ""}
FIGURES = {"lock_time_us": "lock_time_us", "rows_sent": "rows_sent", "rows_examined": "rows_examined", "rows_affected": "rows_affected"}
SAMPLE = {"sql": "sql", "database": "database", "user": "user", "host": "host", "query_time_us": "query_time_us", "rows_examined": "rows_examined", "rows_sent": "rows_sent", "timestamp": "ts"}


def _figures(c, name: str) -> dict:
    return {"sum": c[f"{name}_sum"], "avg": c[f"{name}_mean"], "min": c[f"{name}_min"], "max": c[f"{name}_max"]}


def _class(c) -> dict:
    tally = lambda found: [{"name": x.name, "count": x.n} for x in found or ()]
    return {
        "rank": c["rank"], "id": c.class_id, "kind": c.kind, "fingerprint": c.fingerprint, "label": label_of(c.kind, c.tables, c.fingerprint), "tables": list(c.tables), "calls": c.calls, "time_share": c.time_share,
        "query_time_us": {**_figures(c, "query_time_us"), "p50": c.p50_us, "p95": c.p95_us, "p99": c.p99_us},
        **{key: _figures(c, name) for key, name in FIGURES.items()},
        "bytes_sent": c.bytes_sent,
        "flags": {"full_scan": c.full_scan_count, "filesort": c.filesort_count, "tmp_table": c.tmp_table_count, "tmp_table_on_disk": c.tmp_disk_count},
        "latency_decades": [c[f"d{k}"] for k in range(8)],
        "first_seen": c.first_seen, "last_seen": c.last_seen, "databases": tally(c.databases), "users": tally(c.users),
        "sample": {key: c[f"worst_{name}"] for key, name in SAMPLE.items()},
        "findings": [_finding(f) for f in c.findings],
    }


def _finding(f) -> dict:
    row = f._asdict() if hasattr(f, "_asdict") else f.asDict()
    return {k: row[k] for k in ("rule_id", "rule_name", "severity", "title", "detail", "suggestion")}


def document(report: Report) -> dict:
    """The report as the JSON format lays it out."""
    run, t = report.run, report.totals
    known = {"chunks": run.get("splits", 0), "threads": run.get("splits", 0), "database_filter": run.get("options", {}).get("database", "")}
    return {
        "tool": {"name": "tidemark", "version": __version__},
        "run": {k: run.get(k, known.get(k, nothing)) for k, nothing in RUN_FIELDS.items()},
        "totals": {"events": t["calls"], **{k: t[f"{k}_sum"] or 0 for k in ("query_time_us", *FIGURES)}, "first_seen": t["first_seen"], "last_seen": t["last_seen"]},
        "sort": run.get("sort", "time"),
        "class_count": run["class_count"],
        "findings": report.severities,
        "classes": [_class(c) for c in report.classes],
    }


def to_json(report: Report) -> str:
    """The whole report; numbers that are no numbers become null."""
    return json.dumps(_clean(document(report)), ensure_ascii=False, indent=2)


def cell(text: str) -> str:
    """Text for a Markdown table cell."""
    return re.sub(r"\s+", " ", text.replace("|", "\\|")).strip()


def _line(c) -> tuple:
    return c["rank"], f"{c.time_share * 100:.1f}%", format_duration(c.query_time_us_sum / 1e6), format_count(c.calls), format_duration(c.query_time_us_mean / 1e6), format_duration(c.p95_us / 1e6), format_compact(c.rows_examined_mean)


def to_markdown(report: Report, details: int = 10) -> str:
    out = ["# Query log report", "", f"{format_count(report.totals['calls'])} events in {format_count(report.run['class_count'])} classes.", "", "| # | share | time | calls | mean | p95 | rows examined | query |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    out += ["| " + " | ".join([*map(str, _line(c)), f"`{cell(abbreviate(c.fingerprint, 80))}`"]) + " |" for c in report.classes]
    for c in report.classes[:details]:
        if c.findings:
            out += ["", f"## {c['rank']}. {cell(abbreviate(c.fingerprint, 80))}", "", "```sql", c.worst_sql, "```", ""]
            out += [f"- **{f.severity}** {f.rule_id} {cell(f.title)}: {cell(f.detail)} {cell(f.suggestion)}" for f in c.findings]
    return "\n".join(out) + "\n"


def to_text(report: Report, color: bool = False, width: int = 100, details: int = 10) -> str:
    out = [f"{format_count(report.totals['calls'])} events, {format_count(report.run['class_count'])} classes, {format_duration((report.totals['query_time_us_sum'] or 0) / 1e6)} in total", ""]
    head = ("#", "share", "time", "calls", "mean", "p95", "examined")
    spec = "{:>3} {:>6} {:>9} {:>9} {:>9} {:>9} {:>8}  "
    out.append(spec.format(*head) + "latency   query")
    for c in report.classes:
        line = spec.format(*_line(c))
        out.append(line + sparkline([c[f"d{k}"] for k in range(8)]) + "  " + abbreviate(c.fingerprint, max(10, width - len(line) - 10)))
    for c in report.classes[:details]:
        if c.findings:
            out += ["", f"{c['rank']}. {abbreviate(c.worst_sql, width - 4)}"]
            out += findings_text(c.findings, color, width)
    return "\n".join(out) + "\n"


def wrapped(text: str, width: int, indent: str = "") -> list[str]:
    """Lines of at most ``width`` characters, each after ``indent``; words that are longer stay whole."""
    return textwrap.wrap(text, max(20, width), initial_indent=indent, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)


def findings_text(findings, color: bool = False, width: int = 100) -> list[str]:
    out = []
    for f in findings:
        level = f"{STYLES[f.severity]}{f.severity}\x1b[0m" if color else f.severity
        out += [f"   [{level}] {f.rule_id} {f.title}", *wrapped(f.detail, width, " " * 6), *(f"      > {x}" for x in f.suggestion.split("\n") if x)]
    return out


def findings_json(findings) -> str:
    return json.dumps([_finding(f) for f in findings], ensure_ascii=False, indent=2)


FORMATS = {"text": to_text, "json": to_json, "markdown": to_markdown, "md": to_markdown}


def render(report: Report, form: str = "text", **options) -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")
    return FORMATS[form](report, **options)
