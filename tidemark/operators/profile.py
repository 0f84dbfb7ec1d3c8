"""Profiles of query classes: mergeable aggregates over an event DataFrame.

All functions take events with the columns of ``EVENT_COLUMNS`` they name and aggregate with built-in functions, so
each has a map-side partial step and one exchange by class; results do not depend on how the input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.histogram import DECADES, bucket_of, decade_of, lower_of, width_of
from ..sources.scratch import stage

METRICS = ("query_time_us", "lock_time_us", "rows_sent", "rows_examined", "rows_affected")
FLAGS = ("full_scan", "filesort", "tmp_table", "tmp_disk")
EVENT_COLUMNS = "seq long, sql string, database string, user string, host string, query_time_us long, lock_time_us long, rows_sent long, rows_examined long, rows_affected long, bytes_sent long, thread_id long, ts long, full_scan boolean, filesort boolean, tmp_table boolean, tmp_disk boolean"


def mean_of(name: str) -> Column:
    """Exact sum over count, not a running average."""
    return F.sum(name).cast("double") / F.count(F.lit(1)).cast("double")


def _summary(events: DataFrame) -> list[Column]:
    here = [m for m in METRICS if m in events.columns]
    out = [F.count(F.lit(1)).alias("calls")]
    for m in here:
        out += [F.sum(m).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), mean_of(m).alias(f"{m}_mean")]
    if "bytes_sent" in events.columns:
        out.append(F.sum("bytes_sent").alias("bytes_sent"))
    for f in (x for x in FLAGS if x in events.columns):
        out += [F.count_if(f).alias(f"{f}_count"), (F.count_if(f).cast("double") / F.count(F.lit(1)).cast("double")).alias(f"{f}_ratio")]
    if "ts" in events.columns:
        seen = F.nullif("ts", F.lit(0))
        out += [F.coalesce(F.min(seen), F.lit(0)).alias("first_seen"), F.coalesce(F.max(seen), F.lit(0)).alias("last_seen")]
    return out


def class_profile(events: DataFrame) -> DataFrame:
    """Counts, sums, extremes, means, flag ratios and first and last time of each class; time 0 is unknown."""
    return events.groupBy("class_id").agg(*_summary(events))


def totals(events: DataFrame) -> DataFrame:
    """The same over the whole log, as one row."""
    return events.agg(*_summary(events))


def latency_histogram(events: DataFrame, value: str = "query_time_us") -> DataFrame:
    """``class_id, bucket, n``: exact counts, so histograms of parts add up to the histogram of the whole."""
    return events.groupBy("class_id", bucket_of(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("class_id", "bucket").agg(F.sum("n").alias("n"))


def latency_percentiles(events: DataFrame, quantiles: dict[str, float] | None = None, value: str = "query_time_us") -> DataFrame:
    """Nearest-rank percentiles of each class from its histogram: middle of the bucket, kept within min and max."""
    return percentiles_of(events.groupBy("class_id", bucket_of(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")), quantiles)


def percentiles_of(fine: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Percentiles from a histogram ``class_id, bucket, n`` with the extremes ``least, most`` of each bucket."""
    quantiles = quantiles or {"p50_us": 0.50, "p95_us": 0.95, "p99_us": 0.99}
    of_class, upto = Window.partitionBy("class_id"), Window.partitionBy("class_id").orderBy("bucket")
    ranked = fine.select("class_id", "bucket", "least", "most", F.sum("n").over(upto).alias("seen"), F.sum("n").over(of_class).alias("calls"))
    middle = lower_of(F.col("bucket")) + F.floor((width_of(F.col("bucket")) - 1) / 2).cast("long")
    picks = []
    for name, q in quantiles.items():
        rank = F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("calls")))
        picks.append(F.least(F.greatest(F.min(F.when(F.col("seen") >= rank, F.col("middle"))), F.min("least")), F.max("most")).alias(name))
    return ranked.withColumn("middle", middle).groupBy("class_id").agg(*picks)


def latency_decades(events: DataFrame, value: str = "query_time_us") -> DataFrame:
    """Eight counts per class, by the power of ten of the bucket's smallest value."""
    decade = decade_of(bucket_of(F.col(value)))
    return events.groupBy("class_id").agg(*(F.count_if(decade == k).alias(f"d{k}") for k in range(DECADES)))


FEW_CLASSES = 1 << 18  # classes whose worst events are looked up through a broadcast of two numbers each


def slowness() -> Column:
    """A number that orders events by time, and equally slow ones from the last to the first in the log.

    A decimal, unlike a struct, keeps the aggregate below on the hash path, so no task sorts its events by class.
    """
    whole = lambda n: F.lit(str(n)).cast("decimal(19,0)")
    return F.col("query_time_us").cast("decimal(19,0)") * whole(1 << 63) + (whole((1 << 63) - 1) - F.col("seq").cast("decimal(19,0)"))


def worst_sample(events: DataFrame, *columns: str) -> DataFrame:
    """The slowest event of each class; of equally slow ones the first in the log.

    The aggregate sees two numbers of an event; the other columns are fetched for the few events that it names.
    """
    keep = columns or tuple(c for c in ("sql", "database", "user", "host", "query_time_us", "rows_sent", "rows_examined", "ts", "seq") if c in events.columns)
    worst = stage(events.groupBy("class_id").agg(F.max(slowness()).alias("slowness")), "worst")
    named = F.broadcast(worst) if worst.count() <= FEW_CLASSES else worst
    found = events.withColumn("slowness", slowness()).join(named, ["class_id", "slowness"])
    return found.select("class_id", *(F.col(c).alias(f"worst_{c}") for c in keep))


def tally(events: DataFrame, column: str) -> DataFrame:
    """``class_id, name, n, place``: non-empty values of a column by count descending, then name."""
    counted = events.where((F.col(column).isNotNull()) & (F.col(column) != "")).groupBy("class_id", F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return placed(counted)


def placed(counted: DataFrame) -> DataFrame:
    """Counts of names within classes with their place."""
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(F.col("n").desc(), "name")))


def filter_database(events: DataFrame, database: str) -> DataFrame:
    """Events of one database, compared without regard to ASCII case."""
    return events.where(ascii_lower(F.col("database")) == ascii_lower(F.lit(database)))


def filtered_count(events: DataFrame, database: str) -> DataFrame:
    """How many events the filter keeps and how many it leaves out."""
    kept = F.coalesce(ascii_lower(F.col("database")) == ascii_lower(F.lit(database)), F.lit(False))
    return events.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
