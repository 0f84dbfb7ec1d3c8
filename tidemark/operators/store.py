"""History of runs as Parquet tables partitioned by run, and the same interface in memory.

A run is one partition of each table, written once; what an upsert would maintain is derived from the snapshots.  A
writer claims its run's number by creating a file, which only one of several writers can do, and adds the row in ``runs``
last; rows of the other tables show only with that row, so a run is there as a whole or not at all.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import ChangePolicy, changes, ordered_findings, query_classes

RUN = "run_id long, source string, events long, skipped long, class_count long, total_query_time_us long, window_start long, window_end long, critical long, warning long, info long"
SNAPSHOT = "run_id long, class_id string, rank int, label string, kind string, fingerprint string, calls long, time_share double, total_time_us long, avg_time_us double, p50_us long, p95_us long, p99_us long, max_us long, rows_examined long, rows_sent long, full_scan_ratio double, filesort_ratio double, tmp_disk_ratio double, sample_sql string, sample_database string"
FINDING = "run_id long, class_id string, id long, rule_id string, rule_name string, severity string, title string, detail string, suggestion string"
TABLES = {"runs": RUN, "snapshots": SNAPSHOT, "findings": FINDING}
#: Longest label, title and database name that are kept.
LABEL, TITLE, DATABASE = 255, 512, 64


class HistoryStore(Protocol):
    def save(self, run: DataFrame, snapshots: DataFrame, findings: DataFrame) -> int: ...

    def table(self, name: str) -> DataFrame: ...


class _Reads:
    """Reads that every store offers, over its tables."""

    def runs(self, newest: int = 50) -> DataFrame:
        return self.table("runs").orderBy(F.col("run_id").desc()).limit(newest)

    def run(self, run_id: int) -> DataFrame:
        return self.table("runs").where(F.col("run_id") == run_id)

    def latest_run(self) -> int:
        """The largest run id, 0 if there is none."""
        return self.table("runs").agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]

    def classes(self, run_id: int) -> DataFrame:
        """Snapshots of a run with first and last run of their classes and their findings, by rank."""
        found = ordered_findings(self.table("findings").where(F.col("run_id") == run_id))
        listed = found.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("place", "rule_id", "severity", "title"))).alias("findings"))
        own = self.table("snapshots").where(F.col("run_id") == run_id)
        return own.join(query_classes(self.table("snapshots")), "class_id").join(listed, "class_id", "left").orderBy("rank")

    def snapshot(self, run_id: int, class_id: str) -> DataFrame:
        return self.table("snapshots").where((F.col("run_id") == run_id) & (F.col("class_id") == class_id))

    def history(self, class_id: str, newest: int = 30) -> DataFrame:
        points = self.table("snapshots").where(F.col("class_id") == class_id).orderBy(F.col("run_id").desc()).limit(newest)
        return points.join(self.table("runs").select("run_id", "source"), "run_id").orderBy("run_id")

    def changes(self, run_id: int, policy: ChangePolicy = ChangePolicy()) -> DataFrame:
        """Significant changes in a run: only its own classes are compared."""
        table = self.table("snapshots").where(F.col("run_id") <= run_id)
        own = table.where(F.col("run_id") == run_id).select("class_id")
        return changes(table.join(own, "class_id", "left_semi"), policy).where(F.col("run_id") == run_id)

    def findings(self, run_id: int, class_id: str | None = None) -> DataFrame:
        rows = self.table("findings").where(F.col("run_id") == run_id)
        return ordered_findings(rows if class_id is None else rows.where(F.col("class_id") == class_id))


def shaped(table: DataFrame, schema: str) -> DataFrame:
    """The columns of a table's schema; what is missing is null, what is too long is cut."""
    cut = {"label": LABEL, "title": TITLE, "sample_database": DATABASE}
    out = []
    for field in schema.split(", "):
        name, kind = field.split()
        column = F.col(name) if name in table.columns else F.lit(None)
        out.append((F.substring(column, 1, cut[name]) if name in cut else column).cast(kind).alias(name))
    return table.select(*out)


class ParquetHistory(_Reads):
    """Tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in TABLES.items():  # creates what is missing, once
            path = f"{self.folder}/{name}"
            if not self._exists(path):
                spark.createDataFrame([], schema).write.mode("append").partitionBy("run_id").parquet(path)

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        system, where = self._path(path)
        return system.exists(where)

    def table(self, name: str) -> DataFrame:
        table = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}").select(*(f.split()[0] for f in TABLES[name].split(", ")))
        return table if name == "runs" else table.join(self.table("runs").select("run_id"), "run_id", "left_semi")

    def _claim(self) -> int:
        """A run number that no other writer has."""
        number = self.latest_run() + 1
        system, _ = self._path(self.folder)
        while not system.createNewFile(self._path(f"{self.folder}/_claims/{number}")[1]):
            number += 1
        return number

    def save(self, run: DataFrame, snapshots: DataFrame, findings: DataFrame) -> int:
        """Appends one run and returns its id; the row in ``runs`` is written last and makes the run visible."""
        run_id = self._claim()
        for name, rows in (("findings", findings), ("snapshots", snapshots), ("runs", run)):
            shaped(rows.withColumn("run_id", F.lit(run_id)), TABLES[name]).write.mode("append").partitionBy("run_id").parquet(f"{self.folder}/{name}")
        return run_id

    def delete(self, run_id: int) -> None:
        """Removes a run from all tables, its row in ``runs`` first."""
        for name in ("runs", "snapshots", "findings"):
            system, where = self._path(f"{self.folder}/{name}/run_id={run_id}")
            system.delete(where, True)


class MemoryHistory(_Reads):
    """The same, as DataFrames of collected rows: for reports, which hold the classes that a person reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, {name: [] for name in TABLES}

    def table(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(self.rows[name], TABLES[name])

    def save(self, run: DataFrame, snapshots: DataFrame, findings: DataFrame) -> int:
        run_id = max((r.run_id for r in self.rows["runs"]), default=0) + 1
        for name, rows in (("runs", run), ("snapshots", snapshots), ("findings", findings)):
            self.rows[name] += shaped(rows.withColumn("run_id", F.lit(run_id)), TABLES[name]).collect()
        return run_id

    def delete(self, run_id: int) -> None:
        for name, rows in self.rows.items():
            self.rows[name] = [r for r in rows if r.run_id != run_id]
