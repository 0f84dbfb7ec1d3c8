"""History of runs: snapshots, comparison with the run before, and tables derived from snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "warning", "info")


@dataclass(frozen=True)
class ChangePolicy:
    """What counts as a change: ratio, difference in microseconds, calls on both sides (fixed values as defaults)."""

    ratio: float = 1.5
    least_delta_us: float = 1_000.0
    least_calls: int = 10


def snapshots(events: DataFrame) -> DataFrame:
    """``run_id, class_id, calls, total_time_us, avg_time_us, max_us`` from events with a ``run_id``."""
    return events.groupBy("run_id", "class_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("query_time_us").alias("total_time_us"),
        (F.sum("query_time_us").cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_time_us"),
        F.max("query_time_us").alias("max_us"),
    )


def compared(table: DataFrame) -> DataFrame:
    """Each snapshot beside the latest earlier one of its class."""
    before = Window.partitionBy("class_id").orderBy("run_id")
    return table.select(
        "run_id", "class_id", "calls", "avg_time_us", F.lag("avg_time_us").over(before).alias("previous_avg_us"), F.lag("calls").over(before).alias("previous_calls")
    )


def changes(table: DataFrame, policy: ChangePolicy = ChangePolicy()) -> DataFrame:
    """Significant changes of a class's average time: ``direction`` is regression or improvement."""
    ratio = F.col("avg_time_us") / F.col("previous_avg_us")
    both = compared(table).where((F.col("previous_avg_us") > 0) & (F.col("avg_time_us") > 0) & (F.col("calls") >= policy.least_calls) & (F.col("previous_calls") >= policy.least_calls))
    direction = F.when(ratio >= policy.ratio, "regression").when(ratio <= 1.0 / policy.ratio, "improvement")
    return both.select("*", ratio.alias("ratio"), direction.alias("direction")).where(F.col("direction").isNotNull() & (F.abs(F.col("avg_time_us") - F.col("previous_avg_us")) >= policy.least_delta_us))


def ordered_changes(found: DataFrame) -> DataFrame:
    """Changes with ``place``: the worst regression first, the best improvement first, ties by run and class."""
    strength = F.when(F.col("direction") == "regression", -F.col("ratio")).otherwise(F.col("ratio"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("direction").orderBy(strength, "run_id", "class_id")))


def longest_run(runs: DataFrame, column: str = "events") -> DataFrame:
    """The largest value of a column of the runs, 0 without runs."""
    return runs.agg(F.coalesce(F.max(column), F.lit(0)).alias(f"longest_{column}"))


def history_points(table: DataFrame, class_id: str, newest: int) -> DataFrame:
    """The newest snapshots of one class, oldest first by ``run_id``."""
    return table.where(F.col("class_id") == class_id).orderBy(F.col("run_id").desc()).limit(newest).orderBy("run_id")


def latest_run(table: DataFrame) -> DataFrame:
    return table.agg(F.max("run_id").alias("run_id"))


def query_classes(table: DataFrame) -> DataFrame:
    """The table an upsert would leave: first and last run of each class."""
    return table.groupBy("class_id").agg(F.min("run_id").alias("first_run_id"), F.max("run_id").alias("last_run_id"))


def classes_of_run(table: DataFrame, classes: DataFrame, run_id) -> DataFrame:
    """Snapshots of one run with their class rows."""
    return table.where(F.col("run_id") == run_id).join(classes, "class_id")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``place``: by severity, rule and id within their class."""
    level = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity"))
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(level, "rule_id", "id")))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def drop_run(table: DataFrame, run_id) -> DataFrame:
    """A table without one run (of a table partitioned by run, this prunes one partition)."""
    return table.where(F.col("run_id") != run_id)
