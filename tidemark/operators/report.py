"""A whole analysis: profile, ranking, advice and what goes into reports and history."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..advice.catalog import Catalog
from ..advice.rules import SEVERITIES, Engine
from ..functions.formats import abbreviate
from ..functions.histogram import DECADES, bucket_of, decade_of
from ..functions.statements import with_fingerprints
from ..sources.scratch import stage
from . import profile as P
from . import ranking as R
from .advise import with_findings, with_tables


WORST = ("sql", "database", "user", "host", "query_time_us", "rows_sent", "rows_examined", "ts", "seq")


@dataclass(frozen=True)
class Options:
    top: int = 20
    sort: str = "time"
    database: str = ""
    min_severity: str = "info"
    disabled_rules: tuple[str, ...] = ()
    advise: bool = True


@dataclass
class Report:
    """Ranked classes with findings (at most ``top`` of them, as rows), totals and run facts."""

    classes: list
    totals: dict
    run: dict

    @property
    def severities(self) -> dict[str, int]:
        found = [f.severity for c in self.classes for f in c.findings]
        return {s: found.count(s) for s in reversed(SEVERITIES)}

    def as_dict(self) -> dict:
        return {"run": self.run, "totals": self.totals, "severities": self.severities, "classes": [c.asDict(recursive=True) for c in self.classes]}


def label_of(kind: str, tables: list[str], fingerprint: str) -> str:
    return f"{kind} {', '.join(tables)}" if tables else abbreviate(fingerprint, 60)


def cells(events: DataFrame) -> DataFrame:
    """Everything a report needs, merged over (class, latency bucket, database, user) in one pass over the events.

    The table is kept in the shared folder: it is as small as the number of such cells, and all further aggregates
    merge its rows instead of reading the log again.
    """
    n = F.count(F.lit(1))
    sums = [F.sum(m).alias(f"{m}_sum") for m in P.METRICS] + [F.min(m).alias(f"{m}_min") for m in P.METRICS] + [F.max(m).alias(f"{m}_max") for m in P.METRICS]
    flags = [F.count_if(f).alias(f"{f}_count") for f in P.FLAGS]
    seen = F.nullif("ts", F.lit(0))
    worst = F.max(P.slowness()).alias("slowness")
    keys = ["class_id", bucket_of(F.col("query_time_us")).alias("bucket"), "database", "user"]
    table = events.groupBy(*keys).agg(n.alias("calls"), *sums, *flags, F.sum("bytes_sent").alias("bytes_sent"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), worst, F.min("fingerprint").alias("fingerprint"), F.min("kind").alias("kind"))
    return stage(table, "cells")


def _merged() -> list:
    calls = F.sum("calls").cast("double")
    out = [F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.sum("bytes_sent").alias("bytes_sent")]
    for m in P.METRICS:
        out += [F.sum(f"{m}_sum").alias(f"{m}_sum"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"), (F.sum(f"{m}_sum").cast("double") / calls).alias(f"{m}_mean")]
    for f in P.FLAGS:
        out += [F.sum(f"{f}_count").alias(f"{f}_count"), (F.sum(f"{f}_count").cast("double") / calls).alias(f"{f}_ratio")]
    return [*out, F.coalesce(F.min("first_seen"), F.lit(0)).alias("first_seen"), F.coalesce(F.max("last_seen"), F.lit(0)).alias("last_seen")]


def class_table(table: DataFrame) -> DataFrame:
    """One row per class with everything a report shows, from ``cells``."""
    decades = [F.coalesce(F.sum(F.when(decade_of(F.col("bucket")) == k, F.col("calls"))), F.lit(0)).alias(f"d{k}") for k in range(DECADES)]
    summary = table.groupBy("class_id").agg(*_merged(), *decades, F.min("fingerprint").alias("fingerprint"), F.min("kind").alias("kind"), F.max("slowness").alias("slowness"))
    fine = table.groupBy("class_id", "bucket").agg(F.sum("calls").alias("n"), F.min("query_time_us_min").alias("least"), F.max("query_time_us_max").alias("most"))
    out = summary.join(P.percentiles_of(fine), "class_id")
    for column in ("database", "user"):
        counted = P.placed(table.where(F.col(column) != "").groupBy("class_id", F.col(column).alias("name")).agg(F.sum("calls").alias("n")))
        out = out.join(counted.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "n"))).alias(f"{column}s")), "class_id", "left")
    return out


def ranked_classes(table: DataFrame, events: DataFrame, catalog: Catalog | None = None, options: Options = Options()) -> DataFrame:
    """The report's classes as a DataFrame, from ``cells``: share of the whole, rank, findings of the kept ones.

    ``events`` are those that ``table`` merges; the slowest one of each kept class is fetched from them.
    """
    kept = R.rank_classes(R.time_share(class_table(table)), options.sort, options.top)
    named = kept.select("slowness")
    slow = events.withColumn("slowness", P.slowness()).join(F.broadcast(named) if options.top else named, "slowness")
    kept = kept.join(slow.select("slowness", *(F.col(c).alias(f"worst_{c}") for c in WORST)), "slowness").drop("slowness")
    kept = with_tables(kept, "worst_sql")
    if options.advise:
        return with_findings(kept, catalog, Engine(options.disabled_rules), "worst_sql", options.min_severity)
    return kept.withColumn("findings", F.array().cast("array<struct<ordinal:int,rule_id:string,rule_name:string,severity:string,title:string,detail:string,suggestion:string>>"))


def analyze(events: DataFrame, catalog: Catalog | None = None, options: Options = Options(), run: dict | None = None) -> Report:
    """The report of an event DataFrame; only the kept classes reach the driver."""
    whole = events
    if options.database:
        events = P.filter_database(events, options.database)
    table = cells(with_fingerprints(events))
    classes = sorted(ranked_classes(table, events, catalog, options).collect(), key=lambda c: c["rank"])
    totals = table.agg(*_merged()).first().asDict()
    facts = {"sort": options.sort, "class_count": classes[0].class_count if classes else 0, **(run or {})}
    if options.database:
        facts |= P.filtered_count(whole, options.database).first().asDict()
    return Report(classes, totals, facts | {"options": asdict(options)})


def history_rows(report: Report, spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run, snapshots and findings of a report, for a history store."""
    from .store import FINDING, RUN, SNAPSHOT

    t, names = report.totals, lambda s: [f.split()[0] for f in s.split(", ")]
    run = {"run_id": 0, "source": report.run.get("source", ""), "events": t["calls"], "skipped": report.run.get("skipped", 0), "class_count": report.run["class_count"], "total_query_time_us": t["query_time_us_sum"] or 0, "window_start": t["first_seen"], "window_end": t["last_seen"], **report.severities}
    snapshots, findings = [], []
    for c in report.classes:
        snapshots.append({
            "run_id": 0, "class_id": c.class_id, "rank": c["rank"], "label": abbreviate(label_of(c.kind, c.tables, c.fingerprint), 255), "kind": c.kind, "fingerprint": c.fingerprint, "calls": c.calls, "time_share": c.time_share, "total_time_us": c.query_time_us_sum,
            "avg_time_us": c.query_time_us_mean, "p50_us": c.p50_us, "p95_us": c.p95_us, "p99_us": c.p99_us, "max_us": c.query_time_us_max, "rows_examined": c.rows_examined_sum, "rows_sent": c.rows_sent_sum, "full_scan_ratio": c.full_scan_ratio,
            "filesort_ratio": c.filesort_ratio, "tmp_disk_ratio": c.tmp_disk_ratio, "sample_sql": c.worst_sql, "sample_database": c.worst_database,
        })
        findings += [{"run_id": 0, "class_id": c.class_id, "id": len(findings) + k, **{n: f[n] for n in ("rule_id", "rule_name", "severity", "title", "detail", "suggestion")}} for k, f in enumerate(c.findings)]
    rows = lambda data, schema: spark.createDataFrame([tuple(d[n] for n in names(schema)) for d in data], schema)
    return rows([run], RUN), rows(snapshots, SNAPSHOT), rows(findings, FINDING)
