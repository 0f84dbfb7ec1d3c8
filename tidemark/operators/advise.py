"""Advice over DataFrames of statements or query classes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..advice.catalog import Catalog
from ..advice.rules import RULES, SEVERITIES, Engine, Stats
from ..advice.facts import collect_facts
from ..advice.indexes import suggest
from ..shipping import ship
from ..sql.parser import try_parse
from ..sql.tree import dump
from ..sql.writer import to_sql

FINDINGS = "array<struct<ordinal:int,rule_id:string,rule_name:string,severity:string,title:string,detail:string,suggestion:string>>"
CANDIDATES = "array<struct<ordinal:int,table_name:string,columns:array<string>,ddl:string>>"
PLAN_ROWS = "array<struct<ordinal:int,table_name:string,access_type:string,key_name:string,rows:long,filtered:double,filesort:boolean,temporary:boolean>>"
PREDICATES = "array<struct<ordinal:int,kind:string,column_name:string,negated:boolean,under_or:boolean,wrapper:string>>"
_STATS = ("rows_examined", "rows_sent", "rows_affected", "query_time_us")
_RATIOS = ("full_scan", "filesort", "tmp_disk")


def _valid(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8", "replace")


def with_findings(classes: DataFrame, catalog: Catalog | None = None, engine: Engine | None = None, sql: str = "sql", min_severity: str = "info") -> DataFrame:
    """The frame with ``findings``; columns of a class profile, where present, feed the rules that need numbers.

    The function is marked nondeterministic so that a top-k above it stays below: only the rows that are kept are
    parsed.
    """
    ship(classes.sparkSession)
    engine, least = engine or Engine(), SEVERITIES.index(min_severity)
    numbers = {f"{s}_mean": s for s in _STATS if f"{s}_mean" in classes.columns} | {f"{r}_ratio": r for r in _RATIOS if f"{r}_ratio" in classes.columns}
    with_stats = "calls" in classes.columns and "kind" in classes.columns
    inputs = F.struct(F.col(sql).alias("sql"), *([F.col("kind"), F.col("calls"), *(F.col(c).cast("double").alias(n) for c, n in numbers.items())] if with_stats else []))

    @F.pandas_udf(FINDINGS)
    def compute(frame):
        import pandas as pd

        out = []
        for row in frame.to_dict("records"):
            stats = Stats(row["kind"], int(row["calls"]), **{n: float(row[n]) for n in numbers.values()}) if with_stats else None
            found = [f for f in engine.advise(row["sql"] or "", catalog, stats) if SEVERITIES.index(f.severity) >= least]
            out.append([{"ordinal": k, **{n: _valid(v) for n, v in f._asdict().items()}} for k, f in enumerate(found)])
        return pd.Series(out)

    compute.__annotations__ = {}
    return classes.withColumn("findings", compute.asNondeterministic()(inputs))


def findings(classes: DataFrame, *args, **options) -> DataFrame:
    """One row per finding: the frame's columns but the statement's, then the finding's."""
    table = with_findings(classes, *args, **options)
    keep = [c for c in classes.columns if c in ("class_id", "rank", "run_id")] or [c for c in classes.columns if c != options.get("sql", "sql")]
    return table.select(*keep, F.explode("findings").alias("f")).select(*keep, "f.*")


def index_candidates(statements: DataFrame, catalog: Catalog | None = None, sql: str = "sql") -> DataFrame:
    """One row per suggested index: the frame's columns, then ``ordinal, table_name, columns, ddl``."""
    ship(statements.sparkSession)

    @F.pandas_udf(CANDIDATES)
    def compute(texts):
        import pandas as pd

        def of(text):
            statement, _ = try_parse(text or "")
            found = suggest(collect_facts(statement, catalog), catalog) if statement is not None else []
            return [{"ordinal": k, "table_name": _valid(c.table), "columns": [_valid(x) for x in c.columns], "ddl": _valid(c.ddl)} for k, c in enumerate(found)]

        return pd.Series([of(t) for t in texts])

    compute.__annotations__ = {}
    return statements.select(*statements.columns, F.explode(compute(F.col(sql))).alias("c")).select(*statements.columns, "c.*")


def with_trees(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """The frame with ``tree`` (null if the statement does not parse) and ``error``."""
    ship(statements.sparkSession)

    @F.pandas_udf("tree string, error string")
    def compute(texts):
        import pandas as pd

        found = [try_parse(t or "") for t in texts]
        return pd.DataFrame({"tree": [None if n is None else _valid(dump(n)) for n, _ in found], "error": [_valid(e) for _, e in found]})

    compute.__annotations__ = {}
    return statements.withColumn("_tree", compute(F.col(sql))).select(*statements.columns, "_tree.tree", "_tree.error")


def with_canonical(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """The frame with ``canonical``, the statement as the writer spells it (null if it does not parse), and ``error``."""
    ship(statements.sparkSession)

    @F.pandas_udf("canonical string, error string")
    def compute(texts):
        import pandas as pd

        found = [try_parse(t or "") for t in texts]
        return pd.DataFrame({"canonical": [None if n is None else _valid(to_sql(n)) for n, _ in found], "error": [_valid(e) for _, e in found]})

    compute.__annotations__ = {}
    return statements.withColumn("_sql", compute(F.col(sql))).select(*statements.columns, "_sql.canonical", "_sql.error")


def predicates(statements: DataFrame, catalog: Catalog | None = None, sql: str = "sql") -> DataFrame:
    """One row per condition that the facts of a statement list, in their order."""
    ship(statements.sparkSession)

    @F.pandas_udf(PREDICATES)
    def compute(texts):
        import pandas as pd

        def of(text):
            statement, _ = try_parse(text or "")
            found = collect_facts(statement, catalog).predicates if statement is not None else []
            return [{"ordinal": k, "kind": p.kind, "column_name": _valid(str(p.column)), "negated": bool(p.negated), "under_or": bool(p.under_or), "wrapper": _valid(p.wrapper or "")} for k, p in enumerate(found)]

        return pd.Series([of(t) for t in texts])

    compute.__annotations__ = {}
    return statements.select(*statements.columns, F.explode(compute(F.col(sql))).alias("p")).select(*[c for c in statements.columns if c != sql], "p.*")


def with_tables(classes: DataFrame, sql: str = "sql") -> DataFrame:
    """The frame with ``tables``: the names of the base tables of a statement, each once, in order of appearance.

    Like ``with_findings`` the function stays above a top-k.
    """
    ship(classes.sparkSession)

    @F.pandas_udf("array<string>")
    def compute(texts):
        import pandas as pd

        def of(text):
            statement, _ = try_parse(text or "")
            return list(dict.fromkeys(_valid(t.name) for t in collect_facts(statement, None).base_tables)) if statement is not None else []

        return pd.Series([of(t) for t in texts])

    compute.__annotations__ = {}
    return classes.withColumn("tables", compute.asNondeterministic()(F.col(sql)))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, in the order they run."""
    return spark.createDataFrame([(k, r.id, r.name, r.severity, r.summary) for k, r in enumerate(RULES)], "ordinal int, rule_id string, rule_name string, severity string, summary string")


def catalog_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame(catalog.rows(), "table_name string, column_name string, type string, category string, nullable boolean")


def flatten_plan(text: str) -> list[dict]:
    """Rows of an ``EXPLAIN FORMAT=JSON`` document in reading order; sorting and temporary tables are inherited."""
    out: list[dict] = []

    def walk(node, filesort, temporary):
        if isinstance(node, list):
            for x in node:
                walk(x, filesort, temporary)
        elif isinstance(node, dict):
            filesort, temporary = filesort or bool(node.get("using_filesort")), temporary or bool(node.get("using_temporary_table"))
            for key, value in node.items():
                if key == "table" and isinstance(value, dict):
                    out.append({"ordinal": len(out), "table_name": value.get("table_name"), "access_type": value.get("access_type"), "key_name": value.get("key"), "rows": int(value.get("rows_examined_per_scan") or 0), "filtered": float(value.get("filtered") or 0), "filesort": filesort, "temporary": temporary})
                if isinstance(value, (dict, list)):
                    walk(value, filesort, temporary)

    walk(json.loads(text), False, False)
    return out


def explain_rows(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """One row per table access of each plan document."""
    ship(plans.sparkSession)

    @F.pandas_udf(PLAN_ROWS)
    def compute(texts):
        import pandas as pd

        return pd.Series([flatten_plan(t) if t else [] for t in texts])

    compute.__annotations__ = {}
    rest = [c for c in plans.columns if c != plan]
    return plans.select(*rest, F.explode(compute(F.col(plan))).alias("p")).select(*rest, "p.*")


def index_statements(found: DataFrame) -> DataFrame:
    """``statement, first``: the distinct index statements that missing-index findings suggest, by first appearance.

    ``found`` has ``rule_id, suggestion`` and an ``ordinal`` that orders it.
    """
    first = F.substring_index("suggestion", "\n", 1)
    wanted = found.where((F.col("rule_id") == "ST001") & first.rlike(r"\AALTER TABLE .* ADD INDEX"))
    return wanted.groupBy(first.alias("statement")).agg(F.min("ordinal").alias("first"))


def explain_targets(ranked: DataFrame, most: int) -> DataFrame:
    """The SELECT classes among the ``most`` costliest, whose plans are worth asking for."""
    return ranked.where((F.col("rank") <= most) & (F.col("kind") == "SELECT"))
