"""Advice that needs only a class's numbers, as expressions over the class profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rows-examined rule (mean rows, ratio) and of the temporary-table rule (share).
ROWS_WARNING, ROWS_CRITICAL, DISK_SHARE = (1_000.0, 100.0), (100_000.0, 10_000.0), 0.1


def rows_examined_ratio(profile: DataFrame) -> DataFrame:
    """ST014: classes that examine many rows for each row they return or change."""
    produced = F.when(F.col("kind") == "SELECT", F.col("rows_sent_sum")).otherwise(F.col("rows_affected_sum")) if "kind" in profile.columns else F.col("rows_sent_sum")
    per_call = produced.cast("double") / F.col("calls").cast("double")
    ratio = F.col("rows_examined_mean") / F.greatest(per_call, F.lit(1.0))
    level = F.when((F.col("rows_examined_mean") >= ROWS_CRITICAL[0]) & (ratio >= ROWS_CRITICAL[1]), "critical").otherwise("warning")
    return profile.select("class_id", F.lit("ST014").alias("rule_id"), level.alias("severity"), "rows_examined_mean", ratio.alias("ratio")).where((F.col("rows_examined_mean") >= ROWS_WARNING[0]) & (F.col("ratio") >= ROWS_WARNING[1]))


def tmp_tables_on_disk(profile: DataFrame) -> DataFrame:
    """ST015: classes whose temporary tables often go to disk."""
    return profile.where((F.col("tmp_disk_count") > 0) & (F.col("tmp_disk_ratio") >= DISK_SHARE)).select("class_id", F.lit("ST015").alias("rule_id"), F.lit("warning").alias("severity"), F.col("tmp_disk_ratio").alias("ratio"))
