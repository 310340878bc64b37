"""Change rows as they arrive: churn and commits by file and day, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.activity import churn


def daily_activity(changes: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """changes may be a stream (date is its event time) or a table."""
    timed = changes.withWatermark("date", late) if changes.isStreaming else changes
    per = timed.groupBy(F.window("date", width).alias("day"), "file_path").agg(F.count("*").alias("rows"), F.sum(churn()).alias("churn"), F.approx_count_distinct("commit_hash").alias("commits"))
    return per.select(F.col("day.start").alias("day"), "file_path", "rows", "churn", "commits")
