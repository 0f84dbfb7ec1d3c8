"""Queries over a history store that is filled from the driver's ``events``: three runs, six hours each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.store import ParquetHistory
from ..sources.scratch import scratch_folder
from .event_queries import VIEW, event_view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SLICES = (4, 5, 6)


def _query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = f"WITH {VIEW}, {_STORED} {sql}"
        return function

    return register


#: The store's tables: run numbers begin at 1; of each class the label is cut to 255 characters.
_STORED = f"""
    st AS (SELECT run_id - {SLICES[0] - 1} AS run_id, class_id, calls, total_time_us, avg_time_us, max_us FROM sn WHERE run_id IN {SLICES}),
    rn AS (SELECT run_id, 'slice ' || run_id AS source, sum(calls)::BIGINT AS events, count(*) AS class_count FROM st GROUP BY run_id),
    fi AS (SELECT run_id, class_id, r.rule_id AS rule_id, r.severity AS severity, 'found in ' || class_id AS title
           FROM st, (VALUES ('ST002', 'critical', 2), ('ST001', 'warning', 1), ('ST013', 'info', 3)) r(rule_id, severity, least) WHERE length(class_id) % 4 >= r.least)
"""


def _store(spark, sf_dir) -> ParquetHistory:
    store = ParquetHistory(spark, scratch_folder(spark, "history"))
    table = H.snapshots(event_view(spark, sf_dir).withColumn("class_id", F.col("event_type")))
    for number, slice_ in enumerate(SLICES, 1):
        own = table.where(F.col("run_id") == slice_).drop("run_id").withColumn("label", F.repeat("class_id", 100)).withColumn("rank", F.lit(number))
        run = own.agg(F.sum("calls").alias("events"), F.count(F.lit(1)).alias("class_count")).withColumn("source", F.lit(f"slice {number}"))
        rules = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(n).alias("least")) for r, s, n in (("ST013", "info", 3), ("ST002", "critical", 2), ("ST001", "warning", 1))))
        found = own.select("class_id", F.posexplode(rules).alias("id", "r")).where(F.length("class_id") % 4 >= F.col("r.least"))
        store.save(run, own, found.select("class_id", F.col("id").cast("long").alias("id"), "r.rule_id", "r.severity", F.concat(F.lit("found in "), "class_id").alias("title")))
    return store


@_query("SELECT run_id, source, events, class_count FROM rn ORDER BY run_id DESC LIMIT 2")
def stored_runs(spark, sf_dir):
    return _store(spark, sf_dir).runs(2).select("run_id", "source", "events", "class_count")


@_query("SELECT run_id, class_id, calls, avg_time_us, source FROM st JOIN rn USING (run_id) WHERE class_id = (SELECT min(class_id) FROM st) ORDER BY run_id DESC LIMIT 2")
def stored_history(spark, sf_dir):
    """The newest two points of a class, with their runs."""
    store = _store(spark, sf_dir)
    first = store.table("snapshots").agg(F.min("class_id")).first()[0]
    return store.history(first, 2).select("run_id", "class_id", "calls", "avg_time_us", "source")


@_query("""SELECT s.class_id, s.calls, substr(repeat(s.class_id, 100), 1, 255) AS label, f.first_run_id, f.last_run_id, coalesce(g.found, '') AS found
           FROM st s JOIN (SELECT class_id, min(run_id) AS first_run_id, max(run_id) AS last_run_id FROM st GROUP BY class_id) f USING (class_id)
           LEFT JOIN (SELECT run_id, class_id, string_agg(severity || ' ' || rule_id, ',' ORDER BY list_position(['critical', 'warning', 'info'], severity), rule_id) AS found FROM fi GROUP BY ALL) g
           ON g.run_id = s.run_id AND g.class_id = s.class_id WHERE s.run_id = 2""")
def stored_classes(spark, sf_dir):
    """The classes of a run with their first and last runs and their findings, attached in order."""
    found = F.array_join(F.transform("findings", lambda f: F.concat_ws(" ", f["severity"], f["rule_id"])), ",")
    return _store(spark, sf_dir).classes(2).select("class_id", "calls", "label", "first_run_id", "last_run_id", F.coalesce(found, F.lit("")).alias("found"))


@_query("SELECT class_id, rule_id, severity, title FROM fi WHERE run_id = 3 AND class_id = (SELECT max(class_id) FROM fi)")
def stored_findings(spark, sf_dir):
    store = _store(spark, sf_dir)
    last = store.table("findings").agg(F.max("class_id")).first()[0]
    return store.findings(3, last).select("class_id", "rule_id", "severity", "title")


@_query("""SELECT run_id, class_id, ratio, direction, row_number() OVER (PARTITION BY direction ORDER BY CASE direction WHEN 'regression' THEN -ratio ELSE ratio END, run_id, class_id) AS place FROM cg""")
def changes_by_ratio(spark, sf_dir):
    """Changes from the worst regression and the best improvement on."""
    table = H.snapshots(event_view(spark, sf_dir).withColumn("class_id", F.col("event_type")))
    return H.ordered_changes(H.changes(table)).select("run_id", "class_id", "ratio", "direction", "place")


@_query("SELECT max(events) AS longest_events FROM rn")
def longest_run(spark, sf_dir):
    return H.longest_run(_store(spark, sf_dir).runs())
