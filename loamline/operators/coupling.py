"""Files that change together, and the pain score of size, volatility and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import decay, ratio, rounded
from .activity import churn, in_window

HALF_LIFE = 30.0


def touched(changes: DataFrame, now: str, days: int) -> DataFrame:
    """One row a (commit, file) with the commit's weight."""
    return in_window(changes, now, days).groupBy("commit_hash", "file_path").agg(F.max(decay(F.col("date"), now, HALF_LIFE)).alias("weight"))


def pairs(changes: DataFrame, now: str, days: int, min_shared: int = 2) -> DataFrame:
    """file_a < file_b with shared_commits, total_commits, coupling_strength, support, expected_cochange
    and lift, for pairs of min_shared or more commits and a lift above 1.

    Files with fewer commits than min_shared can't be in such a pair and leave before the self-join; both
    its sides read one exchange by commit."""
    each = touched(changes, now, days)
    per_file = each.groupBy("file_path").agg(F.count("*").alias("commits"), F.sum("weight").alias("weights"))
    total = each.agg(F.countDistinct("commit_hash").alias("total_commits"))
    often = each.join(per_file.where(F.col("commits") >= min_shared).select("file_path"), "file_path", "left_semi")
    a, b = often.alias("a"), often.alias("b")
    both = a.join(b, (F.col("a.commit_hash") == F.col("b.commit_hash")) & (F.col("a.file_path") < F.col("b.file_path")))
    shared = both.groupBy(F.col("a.file_path").alias("file_a"), F.col("b.file_path").alias("file_b")).agg(F.count("*").alias("shared_commits"), F.sum("a.weight").alias("weight"))
    shared = shared.where(F.col("shared_commits") >= min_shared)
    ends = [per_file.select(F.col("file_path").alias(f"file_{s}"), F.col("commits").alias(f"commits_{s}"), F.col("weights").alias(f"weights_{s}")) for s in "ab"]
    met = shared.join(ends[0], "file_a").join(ends[1], "file_b").join(F.broadcast(total))
    n = F.col("total_commits")
    expected = (F.col("commits_a").cast("double") / n) * (F.col("commits_b").cast("double") / n) * n
    scored = met.select(
        "file_a",
        "file_b",
        "shared_commits",
        "total_commits",
        rounded(ratio(F.col("weight"), F.col("weights_a") + F.col("weights_b") - F.col("weight"))).alias("coupling_strength"),
        rounded(F.col("shared_commits") / n).alias("support"),
        rounded(expected).alias("expected_cochange"),
        rounded(ratio(F.col("shared_commits"), expected)).alias("lift"),
    )
    return scored.where("lift > 1.0")


def distance(coupled: DataFrame) -> DataFrame:
    """Mean strength of the pairs that a file is in."""
    ends = coupled.select(F.explode(F.array("file_a", "file_b")).alias("file_path"), "coupling_strength")
    return ends.groupBy("file_path").agg(rounded(F.avg("coupling_strength")).alias("distance_raw"))


def pain(changes: DataFrame, coupled: DataFrame, now: str, days: int) -> DataFrame:
    per = in_window(changes, now, days).groupBy("file_path", "commit_hash").agg(F.sum(churn()).alias("churn"))
    per = per.groupBy("file_path").agg(F.sum("churn").alias("size_raw"), F.count("*").alias("volatility_raw"))
    per = per.join(distance(coupled), "file_path", "left").withColumn("distance_raw", F.coalesce("distance_raw", F.lit(0.0)))
    top = per.agg(*(F.max(f"{x}_raw").alias(f"top_{x}") for x in ("size", "volatility", "distance")))
    parts = {x: rounded(ratio(F.col(f"{x}_raw"), F.col(f"top_{x}"))) for x in ("size", "volatility", "distance")}
    met = per.join(F.broadcast(top)).withColumns({f"{x}_normalized": e for x, e in parts.items()})
    score = rounded(F.col("size_normalized") * F.col("volatility_normalized") * F.col("distance_normalized"))
    return met.select("file_path", "size_raw", "size_normalized", "volatility_raw", "volatility_normalized", "distance_raw", "distance_normalized", score.alias("pain_score"))
