"""How often, how much and how recently files change; rework; hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numeric import DAY_MICROS, decay, moment, ratio, rounded

HALF_LIFE = 30.0
REWORK_DAYS = 14


def in_window(changes: DataFrame, now: str, days: int) -> DataFrame:
    """Rows from now - days to now, both ends included. A plain range, so it reaches the scan."""
    end = moment(now)
    return changes.where((F.col("date") >= end - F.expr(f"interval {int(days)} days")) & (F.col("date") <= end))


def churn():
    return F.col("lines_added") + F.col("lines_deleted")


def touches(changes: DataFrame, now: str, half_life: float = HALF_LIFE) -> DataFrame:
    """One row a (file, commit): date, churn, weight, and churn times weight."""
    weight = decay(F.col("date"), now, half_life)
    return changes.groupBy("file_path", "commit_hash").agg(F.min("date").alias("date"), F.sum(churn()).alias("churn"), F.max(weight).alias("weight"), F.sum(churn() * weight).alias("weighted_churn"))


def file_activity(changes: DataFrame, now: str, half_life: float = HALF_LIFE, rework_days: int = REWORK_DAYS) -> DataFrame:
    """One row a file: commits, churn, decayed sums, and the share of commits that come within
    rework_days of the file's commit before. The window and the sums use one exchange by file."""
    gap = F.unix_micros("date") - F.lag(F.unix_micros("date")).over(Window.partitionBy("file_path").orderBy("date", "commit_hash"))
    each = touches(changes, now, half_life).withColumn("again", F.coalesce((gap <= rework_days * DAY_MICROS).cast("int"), F.lit(0)))
    per = each.groupBy("file_path").agg(
        F.count("*").alias("change_frequency"), F.sum("churn").alias("code_churn"), F.sum("weight").alias("weighted_frequency"), F.sum("weighted_churn").alias("weighted_churn"), F.sum("again").alias("again")
    )
    return per.withColumn("rework_ratio", ratio(F.col("again"), F.col("change_frequency"))).drop("again")


def hotspots(changes: DataFrame, sizes: DataFrame, now: str, days: int) -> DataFrame:
    """file_path, change_frequency, code_churn, hotspot_score, rework_ratio, file_size.

    The score is decayed commits times decayed churn for its size, each over its largest value."""
    per = file_activity(in_window(changes, now, days), now).join(sizes, "file_path", "left")
    size = F.coalesce("file_size", F.lit(0))
    relative = F.when(size > 0, F.col("weighted_churn") / size).otherwise(F.col("weighted_churn"))
    per = per.withColumns({"file_size": size, "relative": relative})
    top = per.agg(F.max("weighted_frequency").alias("top_frequency"), F.max("relative").alias("top_relative"))
    score = ratio(F.col("weighted_frequency"), F.col("top_frequency")) * ratio(F.col("relative"), F.col("top_relative"))
    return per.join(F.broadcast(top)).select("file_path", "change_frequency", "code_churn", rounded(score).alias("hotspot_score"), rounded(F.col("rework_ratio")).alias("rework_ratio"), "file_size")


def total_commits(changes: DataFrame, now: str, days: int) -> DataFrame:
    return in_window(changes, now, days).agg(F.countDistinct("commit_hash").alias("total_commits"))


def top_hotspots(scored: DataFrame, k: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("hotspot_score"), "file_path").limit(k)


def effort_distribution(scored: DataFrame, thresholds=(50, 80, 90)) -> DataFrame:
    """How many files, in hotspot order, hold each percentage of all churn. The running sum is made by
    score first: rows of one score are few, scores at four digits are at most 10,001."""
    by_score = scored.groupBy("hotspot_score").agg(F.sum("code_churn").alias("churn"), F.count("*").alias("n"))
    rising = Window.orderBy(F.desc("hotspot_score")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = by_score.select(F.col("hotspot_score").alias("score"), F.coalesce(F.sum("churn").over(rising), F.lit(0)).alias("churn_before"), F.coalesce(F.sum("n").over(rising), F.lit(0)).alias("n_before"), F.sum("churn").over(whole).alias("total"))
    # A salt splits the one score that most files share; its order is part of the file order.
    inside = Window.partitionBy("hotspot_score").orderBy("file_path").rowsBetween(Window.unboundedPreceding, 0)
    ranked = scored.withColumns({"running": F.sum("code_churn").over(inside), "nth": F.row_number().over(inside)})
    placed = ranked.join(F.broadcast(base), ranked["hotspot_score"] == base["score"])
    placed = placed.select((F.col("churn_before") + F.col("running")).alias("churn"), (F.col("n_before") + F.col("nth")).alias("place"), "total")
    share = F.col("churn").cast("double") / F.col("total") * 100
    each = placed.where("total > 0").select("place", share.alias("share"), F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    return each.where(F.col("share") >= F.col("threshold")).groupBy("threshold").agg(F.min("place").cast("long").alias("file_count"))


def repo_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.countDistinct("commit_hash").alias("commit_count"), F.min("date").alias("first_commit_date"), F.max("date").alias("last_commit_date"))


def commit_density(changes: DataFrame, now: str, days: int) -> DataFrame:
    """1 / (1 + median days between a file's successive rows, repeats included); 1 for a single row."""
    gap = (F.unix_micros("date") - F.lag(F.unix_micros("date")).over(Window.partitionBy("file_path").orderBy("date"))).cast("double") / float(DAY_MICROS)
    each = in_window(changes, now, days).select("file_path", gap.alias("gap"))
    return each.groupBy("file_path").agg(F.coalesce(1.0 / (1.0 + F.median("gap")), F.lit(1.0)).alias("commit_density"))
