"""The registered queries over the change log. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import decay, rounded
from ..operators import activity, compare, coupling, knowledge
from ..sources import star
from ..sources.star import DAYS, NOW

#: The earlier moment of the comparison.
BEFORE = "2000-08-01"


def changes(spark: SparkSession, d: str) -> DataFrame:
    return star.changes(spark, d)


def hotspots(spark: SparkSession, d: str, now: str = NOW) -> DataFrame:
    return activity.hotspots(changes(spark, d), star.sizes(spark, d), now, DAYS)


def comparison(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_hotspots(hotspots(spark, d, BEFORE), hotspots(spark, d))


def scan_changes(spark: SparkSession, d: str) -> DataFrame:
    return star.changes(spark, d, names=True).select("commit_hash", "date", "file_path", "lines_added", "lines_deleted", "author_email", "author_name")


def file_activity(spark: SparkSession, d: str) -> DataFrame:
    per = activity.file_activity(activity.in_window(changes(spark, d), NOW, DAYS), NOW)
    return per.select("file_path", "change_frequency", "code_churn", rounded(F.col("weighted_frequency")).alias("weighted_frequency"), rounded(F.col("weighted_churn")).alias("weighted_churn"))


def rework_ratio(spark: SparkSession, d: str) -> DataFrame:
    return activity.file_activity(activity.in_window(changes(spark, d), NOW, DAYS), NOW).select("file_path", rounded(F.col("rework_ratio")).alias("rework_ratio"))


def decay_weights(spark: SparkSession, d: str) -> DataFrame:
    dates = activity.in_window(changes(spark, d), NOW, DAYS).select("date").distinct()
    return dates.select("date", rounded(decay(F.col("date"), NOW, 30)).alias("weight_30"), rounded(decay(F.col("date"), NOW, 90)).alias("weight_90"))


def coupling_pairs(spark: SparkSession, d: str) -> DataFrame:
    return coupling.pairs(changes(spark, d), NOW, DAYS)


def commit_density(spark: SparkSession, d: str) -> DataFrame:
    return activity.commit_density(changes(spark, d), NOW, DAYS).select("file_path", rounded(F.col("commit_density")).alias("commit_density"))


QUERIES = {
    "scan_changes": scan_changes,
    "scan_sizes": star.sizes,
    "repo_summary": lambda s, d: activity.repo_summary(changes(s, d)),
    "window_filter": lambda s, d: activity.in_window(changes(s, d), NOW, DAYS),
    "decay_weights": decay_weights,
    "total_commits": lambda s, d: activity.total_commits(changes(s, d), NOW, DAYS),
    "file_activity": file_activity,
    "rework_ratio": rework_ratio,
    "hotspots": hotspots,
    "top_hotspots": lambda s, d: activity.top_hotspots(hotspots(s, d)),
    "effort_distribution": lambda s, d: activity.effort_distribution(hotspots(s, d)),
    "author_contributions": lambda s, d: knowledge.contributions(changes(s, d), NOW, DAYS),
    "author_names": lambda s, d: knowledge.author_names(star.changes(s, d, names=True)),
    "knowledge_kdi": lambda s, d: knowledge.files(changes(s, d), NOW, DAYS).select("file_path", "knowledge_concentration", "author_count"),
    "knowledge_files": lambda s, d: knowledge.files(changes(s, d), NOW, DAYS),
    "knowledge_authors": lambda s, d: knowledge.with_authors(changes(s, d), NOW, DAYS),
    "knowledge_islands": lambda s, d: knowledge.islands(knowledge.files(changes(s, d), NOW, DAYS)),
    "author_gini": lambda s, d: knowledge.gini(changes(s, d), NOW, DAYS),
    "coupling_pairs": coupling_pairs,
    "coupling_distance": lambda s, d: coupling.distance(coupling_pairs(s, d)),
    "file_pain": lambda s, d: coupling.pain(changes(s, d), coupling_pairs(s, d), NOW, DAYS),
    "compare_hotspots": comparison,
    "compare_counts": lambda s, d: compare.counts(comparison(s, d)),
    "new_files": lambda s, d: compare.only_in(hotspots(s, d), hotspots(s, d, BEFORE)),
    "removed_files": lambda s, d: compare.only_in(hotspots(s, d, BEFORE), hotspots(s, d)),
    "kept_files": lambda s, d: compare.in_both(hotspots(s, d, BEFORE), hotspots(s, d)),
    "commit_density": commit_density,
}
