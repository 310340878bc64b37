"""Two points in time beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded_signed


def compare_hotspots(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row a file of either side: scores, churn and frequency of both, their differences, and status."""
    fields = {"score": "hotspot_score", "churn": "code_churn", "frequency": "change_frequency"}
    a = before.select("file_path", *(F.col(v).alias(f"from_{k}") for k, v in fields.items()))
    b = after.select("file_path", *(F.col(v).alias(f"to_{k}") for k, v in fields.items()))
    met = a.join(b, "file_path", "full")
    old, new = F.col("from_churn").isNull(), F.col("to_churn").isNull()
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in met.columns if c != "file_path"}
    met = met.withColumns({"is_new": old, "is_removed": new}).withColumns(zero)
    met = met.withColumns({"score_delta": rounded_signed(F.col("to_score") - F.col("from_score")), "churn_delta": F.col("to_churn") - F.col("from_churn"), "frequency_delta": F.col("to_frequency") - F.col("from_frequency")})
    status = F.when(F.col("is_new"), "new").when(F.col("is_removed"), "removed").when(F.col("score_delta") > 0, "degraded").when(F.col("score_delta") < 0, "improved").otherwise("unchanged")
    return met.select("file_path", "from_score", "to_score", "score_delta", "from_churn", "to_churn", "churn_delta", "from_frequency", "to_frequency", "frequency_delta", status.alias("status"))


def counts(compared: DataFrame) -> DataFrame:
    names = {"new": "new_hotspot_count", "removed": "removed_hotspot_count", "improved": "improved_count", "degraded": "degraded_count"}
    return compared.agg(*(F.count_if(F.col("status") == k).alias(v) for k, v in names.items()))


def only_in(some: DataFrame, other: DataFrame) -> DataFrame:
    """Files of one side that the other hasn't."""
    return some.select("file_path").join(other.select("file_path"), "file_path", "left_anti")


def in_both(some: DataFrame, other: DataFrame) -> DataFrame:
    return some.select("file_path").join(other.select("file_path"), "file_path", "left_semi")
