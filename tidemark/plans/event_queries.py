"""Queries over the driver's ``events`` table read as a query log, each with DuckDB SQL for the same result.

The table holds no log, so a deterministic view gives its rows the columns of an event; both engines use the same
definition.  Runs are six-hour slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metric_rules as M
from ..operators import profile as P
from ..operators import ranking as R
from ..operators.advise import explain_targets as explain_targets_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the columns of a log event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("long"))
    user = F.col("user_id")
    return e.select(
        F.concat("event_type", F.lit("-"), (user % 10).cast("string")).alias("class_id"),
        F.col("event_id").alias("seq"),
        F.round(F.col("value") * 1000).cast("long").alias("query_time_us"),
        F.concat(F.lit("db"), (user % 4).cast("string")).alias("database"),
        F.concat(F.lit("u"), (user % 7).cast("string")).alias("user"),
        F.when(user % 10 < 5, F.col("k") * 100).otherwise(F.col("k")).alias("rows_examined"),
        (user % 20).alias("rows_sent"),
        (F.col("k") > 50).alias("full_scan"),
        (F.col("k") % 10 == 0).alias("tmp_disk"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type"),
        ((F.dayofmonth("ts") - 1) * 4 + F.floor(F.hour("ts") / 6)).cast("long").alias("run_id"),
    )


VIEW = r"""
    ev AS (
        SELECT event_type || '-' || (user_id % 10)::VARCHAR AS class_id, event_id AS seq, round(value * 1000)::BIGINT AS query_time_us,
               'db' || (user_id % 4)::VARCHAR AS database, 'u' || (user_id % 7)::VARCHAR AS user_name,
               CASE WHEN user_id % 10 < 5 THEN k * 100 ELSE k END AS rows_examined, user_id % 20 AS rows_sent, k > 50 AS full_scan,
               k % 10 = 0 AS tmp_disk, floor(epoch(ts))::BIGINT AS ts, event_type, ((day(ts) - 1) * 4 + hour(ts) // 6)::BIGINT AS run_id
        FROM (SELECT *, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events)),
    pr AS (
        SELECT class_id, count(*) AS calls, sum(query_time_us)::BIGINT AS query_time_us_sum, min(query_time_us) AS query_time_us_min,
               max(query_time_us) AS query_time_us_max, sum(query_time_us)::BIGINT::DOUBLE / count(*)::DOUBLE AS query_time_us_mean,
               sum(rows_sent)::BIGINT AS rows_sent_sum, min(rows_sent) AS rows_sent_min, max(rows_sent) AS rows_sent_max,
               sum(rows_sent)::BIGINT::DOUBLE / count(*)::DOUBLE AS rows_sent_mean,
               sum(rows_examined)::BIGINT AS rows_examined_sum, min(rows_examined) AS rows_examined_min, max(rows_examined) AS rows_examined_max,
               sum(rows_examined)::BIGINT::DOUBLE / count(*)::DOUBLE AS rows_examined_mean,
               count(*) FILTER (WHERE full_scan) AS full_scan_count, (count(*) FILTER (WHERE full_scan))::DOUBLE / count(*)::DOUBLE AS full_scan_ratio,
               count(*) FILTER (WHERE tmp_disk) AS tmp_disk_count, (count(*) FILTER (WHERE tmp_disk))::DOUBLE / count(*)::DOUBLE AS tmp_disk_ratio,
               coalesce(min(nullif(ts, 0)), 0) AS first_seen, coalesce(max(nullif(ts, 0)), 0) AS last_seen
        FROM ev GROUP BY ALL),
    bk AS (
        SELECT class_id, query_time_us AS v,
               CASE WHEN query_time_us < 64 THEN query_time_us
                    ELSE (length(bin(query_time_us)) - 5) * 32 + (query_time_us >> (length(bin(query_time_us)) - 6)::INTEGER) - 32 END AS bucket
        FROM ev),
    hg AS (SELECT class_id, bucket, count(*) AS n, min(v) AS least, max(v) AS most FROM bk GROUP BY ALL),
    bd AS (
        SELECT *, CASE WHEN bucket < 64 THEN bucket ELSE ((32 + bucket % 32)::BIGINT << (bucket // 32 - 1)::INTEGER) END AS low,
               CASE WHEN bucket < 64 THEN 1 ELSE (1::BIGINT << (bucket // 32 - 1)::INTEGER) END AS width FROM hg),
    ru AS (
        SELECT *, sum(n) OVER (PARTITION BY class_id ORDER BY bucket)::BIGINT AS seen, sum(n) OVER (PARTITION BY class_id)::BIGINT AS calls,
               low + (width - 1) // 2 AS middle FROM bd),
    pc AS (
        SELECT class_id,
               least(greatest(min(middle) FILTER (WHERE seen >= greatest(1, ceil(0.5::DOUBLE * calls))), min(least)), max(most))::BIGINT AS p50_us,
               least(greatest(min(middle) FILTER (WHERE seen >= greatest(1, ceil(0.95::DOUBLE * calls))), min(least)), max(most))::BIGINT AS p95_us,
               least(greatest(min(middle) FILTER (WHERE seen >= greatest(1, ceil(0.99::DOUBLE * calls))), min(least)), max(most))::BIGINT AS p99_us
        FROM ru GROUP BY class_id),
    sn AS (
        SELECT run_id, event_type AS class_id, count(*) AS calls, sum(query_time_us)::BIGINT AS total_time_us,
               sum(query_time_us)::BIGINT::DOUBLE / count(*)::DOUBLE AS avg_time_us, max(query_time_us) AS max_us FROM ev GROUP BY ALL),
    lg AS (
        SELECT run_id, class_id, calls, avg_time_us, lag(avg_time_us) OVER w AS previous_avg_us, lag(calls) OVER w AS previous_calls
        FROM sn WINDOW w AS (PARTITION BY class_id ORDER BY run_id)),
    ch AS (
        SELECT *, avg_time_us / previous_avg_us AS ratio,
               CASE WHEN avg_time_us / previous_avg_us >= 1.5::DOUBLE THEN 'regression' WHEN avg_time_us / previous_avg_us <= 1::DOUBLE / 1.5::DOUBLE THEN 'improvement' END AS direction
        FROM lg WHERE previous_avg_us > 0 AND avg_time_us > 0 AND calls >= 10 AND previous_calls >= 10),
    cg AS (SELECT * FROM ch WHERE direction IS NOT NULL AND abs(avg_time_us - previous_avg_us) >= 1000)
"""


def _query(sql: str, name: str | None = None):
    def register(function):
        QUERIES[name or function.__name__] = function
        ORACLE[name or function.__name__] = f"WITH {VIEW} {sql}"
        return function

    return register


def _profile(spark, sf_dir):
    return P.class_profile(event_view(spark, sf_dir))


_TOTALS = "count(*) AS calls, " + ", ".join(
    f"sum({m})::BIGINT AS {m}_sum, min({m}) AS {m}_min, max({m}) AS {m}_max, sum({m})::BIGINT::DOUBLE / count(*)::DOUBLE AS {m}_mean" for m in ("query_time_us", "rows_sent", "rows_examined")
) + ", " + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}_count, (count(*) FILTER (WHERE {f}))::DOUBLE / count(*)::DOUBLE AS {f}_ratio" for f in ("full_scan", "tmp_disk")) + ", coalesce(min(nullif(ts, 0)), 0) AS first_seen, coalesce(max(nullif(ts, 0)), 0) AS last_seen"


@_query(f"SELECT {_TOTALS} FROM ev")
def totals(spark, sf_dir):
    return P.totals(event_view(spark, sf_dir))


@_query("SELECT * FROM pr")
def class_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@_query("SELECT class_id, query_time_us_mean, rows_sent_mean, rows_examined_mean FROM pr")
def class_means(spark, sf_dir):
    return _profile(spark, sf_dir).select("class_id", "query_time_us_mean", "rows_sent_mean", "rows_examined_mean")


@_query("SELECT class_id, full_scan_count, full_scan_ratio, tmp_disk_count, tmp_disk_ratio FROM pr")
def flag_ratios(spark, sf_dir):
    return _profile(spark, sf_dir).select("class_id", "full_scan_count", "full_scan_ratio", "tmp_disk_count", "tmp_disk_ratio")


@_query("SELECT class_id, first_seen, last_seen FROM pr")
def first_last_seen(spark, sf_dir):
    return _profile(spark, sf_dir).select("class_id", "first_seen", "last_seen")


@_query("SELECT class_id, bucket, n FROM hg")
def latency_histogram(spark, sf_dir):
    return P.latency_histogram(event_view(spark, sf_dir))


@_query("SELECT class_id, bucket, n FROM hg")
def histogram_merge(spark, sf_dir):
    events = event_view(spark, sf_dir)
    return P.merge_histograms(*(P.latency_histogram(events.where(F.col("seq") % 3 == k)) for k in range(3)))


@_query("SELECT * FROM pc")
def latency_percentiles(spark, sf_dir):
    return P.latency_percentiles(event_view(spark, sf_dir))


@_query("SELECT class_id, " + ", ".join(f"sum(CASE WHEN least(7, length(low::VARCHAR) - 1) = {k} THEN n ELSE 0 END)::BIGINT AS d{k}" for k in range(8)) + " FROM bd GROUP BY class_id")
def latency_decades(spark, sf_dir):
    return P.latency_decades(event_view(spark, sf_dir))


@_query("SELECT class_id, database AS worst_database, user_name AS worst_user, query_time_us AS worst_query_time_us, rows_sent AS worst_rows_sent, rows_examined AS worst_rows_examined, ts AS worst_ts, seq AS worst_seq FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY query_time_us DESC, seq) AS r FROM ev) WHERE r = 1")
def worst_sample(spark, sf_dir):
    return P.worst_sample(event_view(spark, sf_dir))


_TALLY = "SELECT class_id, {0} AS name, count(*) AS n, row_number() OVER (PARTITION BY class_id ORDER BY count(*) DESC, {0}) AS place FROM ev GROUP BY class_id, {0}"


@_query(_TALLY.format("database"))
def tally_databases(spark, sf_dir):
    return P.tally(event_view(spark, sf_dir), "database")


@_query(_TALLY.format("user_name"))
def tally_users(spark, sf_dir):
    return P.tally(event_view(spark, sf_dir), "user")


@_query("SELECT class_id, query_time_us_sum::DOUBLE / (sum(query_time_us_sum) OVER ())::BIGINT::DOUBLE AS time_share, count(*) OVER () AS class_count FROM pr")
def time_share(spark, sf_dir):
    return R.time_share(_profile(spark, sf_dir)).select("class_id", "time_share", "class_count")


def _ranked(key: str):
    def run(spark, sf_dir):
        events = event_view(spark, sf_dir)
        profile = P.class_profile(events)
        profile = profile.join(P.latency_percentiles(events).select("class_id", "p95_us"), "class_id") if key == "p95" else profile
        return R.rank_classes(profile, key).select("class_id", "rank", R.sort_column(key))

    return run


for _key, _column in R.SORT_KEYS.items():
    _query(f"SELECT class_id, row_number() OVER (ORDER BY {_column} DESC, class_id) AS rank, {_column} FROM pr JOIN pc USING (class_id)", f"rank_by_{_key}")(_ranked(_key))


@_query("SELECT class_id, query_time_us_sum, row_number() OVER (ORDER BY query_time_us_sum DESC, class_id) AS rank FROM pr ORDER BY query_time_us_sum DESC, class_id LIMIT 10")
def top_k(spark, sf_dir):
    return R.rank_classes(_profile(spark, sf_dir), "time", 10).select("class_id", "query_time_us_sum", "rank")


@_query("SELECT class_id, count(*) AS calls FROM ev WHERE lower(database) = 'db2' GROUP BY class_id")
def database_filter(spark, sf_dir):
    return P.filter_database(event_view(spark, sf_dir), "DB2").groupBy("class_id").agg(F.count(F.lit(1)).alias("calls"))


@_query("SELECT count(*) FILTER (WHERE database = 'db2') AS kept, count(*) FILTER (WHERE database <> 'db2') AS filtered FROM ev")
def filtered_count(spark, sf_dir):
    return P.filtered_count(event_view(spark, sf_dir), "db2")


def _snapshots(spark, sf_dir):
    return H.snapshots(event_view(spark, sf_dir).withColumn("class_id", F.col("event_type")))


@_query("SELECT * FROM sn")
def run_snapshots(spark, sf_dir):
    return _snapshots(spark, sf_dir)


@_query("SELECT * FROM lg")
def changes_lag(spark, sf_dir):
    return H.compared(_snapshots(spark, sf_dir))


@_query("SELECT * FROM cg WHERE direction = 'regression'")
def regressions(spark, sf_dir):
    return H.changes(_snapshots(spark, sf_dir)).where("direction = 'regression'")


@_query("SELECT * FROM cg WHERE direction = 'improvement'")
def improvements(spark, sf_dir):
    return H.changes(_snapshots(spark, sf_dir)).where("direction = 'improvement'")


@_query("SELECT * FROM sn WHERE class_id = (SELECT min(class_id) FROM sn) ORDER BY run_id DESC LIMIT 12")
def history_points(spark, sf_dir):
    table = _snapshots(spark, sf_dir)
    first = event_view(spark, sf_dir).agg(F.min("event_type")).first()[0]
    return H.history_points(table, first, 12)


@_query("SELECT max(run_id) AS run_id FROM sn")
def latest_run(spark, sf_dir):
    return H.latest_run(_snapshots(spark, sf_dir))


@_query("SELECT class_id, min(run_id) AS first_run_id, max(run_id) AS last_run_id FROM sn GROUP BY class_id")
def query_class_upsert(spark, sf_dir):
    return H.query_classes(_snapshots(spark, sf_dir))


@_query("SELECT sn.*, f.first_run_id, f.last_run_id FROM sn JOIN (SELECT class_id, min(run_id) AS first_run_id, max(run_id) AS last_run_id FROM sn GROUP BY class_id) f USING (class_id) WHERE run_id = 5")
def run_classes_join(spark, sf_dir):
    table = _snapshots(spark, sf_dir)
    return H.classes_of_run(table, H.query_classes(table), 5)


@_query("SELECT * FROM sn WHERE run_id <> 3")
def run_cascade_delete(spark, sf_dir):
    return H.drop_run(_snapshots(spark, sf_dir), 3)


@_query("SELECT DISTINCT class_id FROM sn WHERE class_id IN (SELECT class_id FROM sn WHERE run_id = 2)")
def classes_in_run_semi(spark, sf_dir):
    table = _snapshots(spark, sf_dir)
    return table.select("class_id").distinct().join(table.where("run_id = 2"), "class_id", "left_semi")


def _findings(spark, sf_dir):
    e = event_view(spark, sf_dir)
    severity = F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), (F.col("seq") % 3 + 1).cast("int"))
    return e.select("class_id", F.col("seq").alias("id"), severity.alias("severity"), F.concat(F.lit("ST0"), F.lpad((F.col("rows_sent") % 15).cast("string"), 2, "0")).alias("rule_id"))


_FIND = "(SELECT class_id, seq AS id, ['critical', 'warning', 'info'][seq % 3 + 1] AS severity, 'ST0' || lpad((rows_sent % 15)::VARCHAR, 2, '0') AS rule_id FROM ev)"


@_query(f"SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY list_position(['critical', 'warning', 'info'], severity), rule_id, id) AS place FROM {_FIND}")
def findings_order(spark, sf_dir):
    return H.ordered_findings(_findings(spark, sf_dir))


@_query(f"SELECT severity, count(*) AS n FROM {_FIND} GROUP BY severity")
def severity_counts(spark, sf_dir):
    return H.severity_counts(_findings(spark, sf_dir))


@_query("""SELECT class_id, 'ST014' AS rule_id, CASE WHEN rows_examined_mean >= 100000 AND ratio >= 10000 THEN 'critical' ELSE 'warning' END AS severity, rows_examined_mean, ratio
           FROM (SELECT *, rows_examined_mean / greatest(rows_sent_sum::DOUBLE / calls::DOUBLE, 1::DOUBLE) AS ratio FROM pr) WHERE rows_examined_mean >= 1000 AND ratio >= 100""")
def st014_rows_ratio(spark, sf_dir):
    return M.rows_examined_ratio(_profile(spark, sf_dir))


@_query("SELECT class_id, 'ST015' AS rule_id, 'warning' AS severity, tmp_disk_ratio AS ratio FROM pr WHERE tmp_disk_count > 0 AND tmp_disk_ratio >= 0.1::DOUBLE")
def st015_tmp_disk(spark, sf_dir):
    return M.tmp_tables_on_disk(_profile(spark, sf_dir))


@_query("SELECT class_id, rank FROM (SELECT class_id, row_number() OVER (ORDER BY query_time_us_sum DESC, class_id) AS rank FROM pr) WHERE rank <= 7 AND class_id LIKE '%-_' AND class_id < 'p'")
def explain_targets(spark, sf_dir):
    """The classes among the costliest seven whose plans are worth asking for, were those of the first letters queries."""
    ranked = R.rank_classes(_profile(spark, sf_dir), "time").withColumn("kind", F.when(F.col("class_id") < "p", "SELECT").otherwise("UPDATE"))
    return explain_targets_of(ranked, 7).select("class_id", "rank")
