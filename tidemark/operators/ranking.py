"""Ranking of query classes, shares of the total and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.histogram import bucket_of

#: Sort keys by name, as columns of a class profile.
SORT_KEYS = {
    "time": "query_time_us_sum",
    "calls": "calls",
    "avg": "query_time_us_mean",
    "p95": "p95_us",
    "max": "query_time_us_max",
    "rows": "rows_examined_sum",
}


def sort_column(key: str) -> str:
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key!r}; known: {', '.join(SORT_KEYS)}")
    return SORT_KEYS[key]


def time_share(profile: DataFrame) -> DataFrame:
    """Each class's share of the time of all classes, before any trimming; 0 if no time was spent."""
    whole = profile.agg(F.sum("query_time_us_sum").alias("whole"), F.count(F.lit(1)).alias("class_count"))
    share = F.when(F.col("whole") > 0, F.col("query_time_us_sum").cast("double") / F.col("whole").cast("double")).otherwise(F.lit(0.0))
    return profile.join(F.broadcast(whole)).withColumn("time_share", share).drop("whole")  # one row by construction


def rank_classes(profile: DataFrame, key: str = "time", top: int = 0) -> DataFrame:
    """The profile with ``rank``, by the key descending and the class id; only the first ``top`` if that is not 0.

    A limit is planned as top-k, so only its rows meet in one task.  Without one, classes are numbered within buckets of
    like values, and the buckets' sizes, of which there are about two thousand at most, give each bucket's first rank.
    """
    column = sort_column(key)
    order = [F.col(column).desc(), F.col("class_id").asc()]
    if top:
        return profile.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    bucketed = profile.withColumn("__bucket", bucket_of(F.greatest(F.coalesce(F.floor(column).cast("long"), F.lit(0)), F.lit(0))))
    above = Window.orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).select("__bucket", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return bucketed.join(F.broadcast(sizes), "__bucket").withColumn("rank", (within + F.col("__before")).cast("int")).drop("__bucket", "__before")
