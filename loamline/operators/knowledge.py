"""Who knows which file: shares, concentration, islands, inequality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numeric import decay, ratio, rounded, rounded_signed
from .activity import churn, in_window

HALF_LIFE = 90.0
ISLAND = 0.8


def contributions(changes: DataFrame, now: str, days: int, half_life: float = HALF_LIFE) -> DataFrame:
    """One row a (file, author): change_count, total_churn, proportion and weighted_proportion."""
    weighted = churn() * decay(F.col("date"), now, half_life)
    per = in_window(changes, now, days).groupBy("file_path", "author_email").agg(F.count("*").alias("change_count"), F.sum(churn()).alias("total_churn"), F.sum(weighted).alias("weighted"))
    of = Window.partitionBy("file_path")
    return per.select(
        "file_path",
        "author_email",
        "change_count",
        "total_churn",
        rounded(ratio(F.col("total_churn"), F.sum("total_churn").over(of))).alias("proportion"),
        rounded(ratio(F.col("weighted"), F.sum("weighted").over(of))).alias("weighted_proportion"),
    )


def author_names(changes: DataFrame) -> DataFrame:
    """The name that each author was last seen with."""
    return changes.groupBy("author_email").agg(F.max_by("author_name", F.struct("date", "commit_hash", "author_name")).alias("author_name"))


def files(changes: DataFrame, now: str, days: int, threshold: float = ISLAND) -> DataFrame:
    """One row a file: knowledge_concentration, primary_author, primary_author_pct, is_knowledge_island,
    author_count. Concentration is 1 less the entropy of the rounded decayed shares over its largest."""
    per = contributions(changes, now, days)
    p = F.col("weighted_proportion")
    grouped = per.groupBy("file_path").agg(
        F.count("*").alias("author_count"),
        F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("entropy"),
        F.max("proportion").alias("primary_author_pct"),
        F.min_by("author_email", F.struct(-F.col("proportion"), F.col("author_email"))).alias("primary_author"),
    )
    top = F.log2(F.col("author_count").cast("double"))
    spread = F.when(F.col("author_count") <= 1, F.lit(1.0)).otherwise(rounded_signed(1.0 - F.col("entropy") / top))
    return grouped.select("file_path", spread.alias("knowledge_concentration"), "primary_author", "primary_author_pct", (F.col("primary_author_pct") > threshold).alias("is_knowledge_island"), "author_count")


def with_authors(changes: DataFrame, now: str, days: int) -> DataFrame:
    """One row a file with its authors as an array, largest share first."""
    per = contributions(changes, now, days)
    each = F.struct((-F.col("proportion")).alias("order"), "author_email", "change_count", "total_churn", "proportion", "weighted_proportion")
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["author_email"].alias("author_email"), x["change_count"].alias("change_count"), x["total_churn"].alias("total_churn"), x["proportion"].alias("proportion"), x["weighted_proportion"].alias("weighted_proportion")))
    return per.groupBy("file_path").agg(listed.alias("authors"))


def gini(changes: DataFrame, now: str, days: int) -> DataFrame:
    """Inequality of the authors' churn: (2 * sum(i * x) - (n + 1) * sum(x)) / (n * sum(x)) over rising x.

    Authors of one churn are one row of the ordered window: the ranks of a tie of m from r on sum to
    m * r + m * (m - 1) / 2, so the window sees as many rows as there are different sums."""
    sums = in_window(changes, now, days).groupBy("author_email").agg(F.sum(churn()).alias("x"))
    ties = sums.groupBy("x").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.select("x", "m", (F.col("m") * (before + 1) + F.floor(F.col("m") * (F.col("m") - 1) / 2)).alias("ranks"))
    all_of = ranked.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("x")).alias("total"), F.sum(F.col("ranks") * F.col("x")).alias("ranked"))
    top = F.col("ranked") * 2.0 - (F.col("n") + 1) * F.col("total")
    return all_of.select(F.coalesce(F.when(F.col("total") > 0, rounded_signed(top.cast("double") / (F.col("n") * F.col("total")))), F.lit(0.0)).alias("developer_risk_index"))


def islands(per_file: DataFrame) -> DataFrame:
    return per_file.agg(F.count_if("is_knowledge_island").alias("knowledge_island_count"))
