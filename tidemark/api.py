"""Entry points: analyse a log, advise on a statement, and the kernels behind them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .advice.catalog import Catalog as SchemaCatalog
from .advice.rules import RULES, Engine, Finding, advise
from .operators.report import Options, Report, analyze
from .sources.generate import write_log as generate_log
from .sources.slowlog import counters, read_log_text, resolved_events, scan_slow_log
from .sql.fingerprint import Fingerprint, fingerprint
from .sql.parser import ParseError, parse
from .sql.tree import dump

__all__ = ["Engine", "Finding", "Fingerprint", "Options", "ParseError", "Report", "SchemaCatalog", "advise", "analyze_file", "analyze_text", "fingerprint", "generate_log", "parse_tree", "rules"]


def _catalog(schema: str | SchemaCatalog | None) -> SchemaCatalog | None:
    return SchemaCatalog.from_ddl(schema) if isinstance(schema, str) else schema


def analyze_file(spark: SparkSession, path: str, schema: str | SchemaCatalog | None = None, options: Options = Options(), split_bytes: int = 64 << 20) -> Report:
    """Analyse a log file, a folder or a pattern; ``schema`` is DDL text or a catalog."""
    raw = scan_slow_log(spark, path, split_bytes, fingerprints=True)
    seen = counters(raw).first()
    run = {"source": path, "skipped": seen.skipped, "lines": seen.lines, "splits": seen.splits}
    return analyze(resolved_events(raw), _catalog(schema), options, run)


def analyze_text(spark: SparkSession, text: str, schema: str | SchemaCatalog | None = None, options: Options = Options()) -> Report:
    """Analyse a log that is already in memory."""
    return analyze(read_log_text(spark, text), _catalog(schema), options, {"source": "text"})


def parse_tree(sql: str) -> str:
    """The syntax tree as indented text; raises ``ParseError``."""
    return dump(parse(sql))


def rules() -> list[tuple[str, str, str, str]]:
    """(id, name, severity, summary) of every rule."""
    return [(r.id, r.name, r.severity, r.summary) for r in RULES]
