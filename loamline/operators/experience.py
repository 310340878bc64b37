"""Developer experience: throughput, feedback, focus and cognitive load in one score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, rounded
from .effort import scaled

#: What a commit of each label counts, what each signal weighs, and the parts of the score.
LABEL_WEIGHTS = {"feature": 1.0, "bugfix": 0.8, "refactoring": 0.5, "mixed": 0.5, "config": 0.3}
LOAD = {"complexity": 0.35, "coordination": 0.25, "knowledge": 0.25, "change_rate": 0.15}
PARTS = (0.3, 0.25, 0.25, 0.2)
DAILY = 10.0


def label_weight(label):
    out = F.lit(0.5)
    for name, w in LABEL_WEIGHTS.items():
        out = F.when(label == name, F.lit(w)).otherwise(out)
    return out


def throughput(clusters: DataFrame, days: int) -> DataFrame:
    raw = F.coalesce(F.sum(F.col("size") * label_weight(F.col("label"))), F.lit(0.0)) / (max(days, 1) * DAILY)
    return clusters.agg(rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("throughput"))


def focus(clusters: DataFrame) -> DataFrame:
    size = F.col("size")
    feature, known = F.sum(F.when(F.col("label") == "feature", size).otherwise(0)), F.sum(F.when(F.col("label") != "mixed", size).otherwise(0))
    return clusters.agg(rounded(F.coalesce(ratio(feature, known, 0.5), F.lit(0.5))).alias("focus_ratio"))


def feedback(hotspots: DataFrame, density: DataFrame) -> DataFrame:
    met = hotspots.join(density, "file_path", "left")
    return met.agg(rounded(F.coalesce(F.avg(F.coalesce("commit_density", F.lit(1.0))) * (1.0 - F.avg("rework_ratio")), F.lit(0.0))).alias("feedback_delay"))


def cognitive_load(hotspots: DataFrame, known: DataFrame, pained: DataFrame, complexity: DataFrame) -> DataFrame:
    """One row a file of any side; what a side lacks is 0. The sides are stacked and grouped, so four
    tables meet in one exchange."""
    zero = F.lit(0.0)
    side = lambda df, name, value: df.select("file_path", *((value if n == name else zero).alias(n) for n in LOAD))
    sides = [
        side(complexity, "complexity", F.col("avg_cognitive").cast("double")),
        side(pained, "coordination", F.col("distance_normalized")),
        side(known, "knowledge", F.col("knowledge_concentration")),
        side(hotspots, "change_rate", F.col("change_frequency").cast("double")),
    ]
    stacked = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    each = scaled(stacked.groupBy("file_path").agg(*(F.sum(n).alias(n) for n in LOAD)), tuple(LOAD))
    total = F.lit(0.0)
    for n, w in LOAD.items():
        total = total + F.col(f"z_{n}") * F.lit(w)
    return each.select("file_path", *(rounded(F.col(f"z_{n}")).alias(f"{n}_score") for n in LOAD), rounded(total).alias("composite_load"))


def report(commits: DataFrame, clusters: DataFrame, hotspots: DataFrame, density: DataFrame, load: DataFrame, days: int, parts=PARTS) -> DataFrame:
    """One row: total_commits, total_files, the four metrics and dx_score. No commits score 0."""
    row = commits.join(hotspots.agg(F.count("*").alias("total_files"))).join(throughput(clusters, days)).join(feedback(hotspots, density)).join(focus(clusters))
    row = row.join(load.agg(rounded(F.coalesce(F.avg("composite_load"), F.lit(0.0))).alias("cognitive_load")))
    score = F.col("throughput") * parts[0] + F.col("feedback_delay") * parts[1] + F.col("focus_ratio") * parts[2] + (1.0 - F.col("cognitive_load")) * parts[3]
    empty = F.col("total_commits") == 0
    return row.select("total_commits", "total_files", "throughput", "feedback_delay", "focus_ratio", F.when(empty, 0.0).otherwise(F.col("cognitive_load")).alias("cognitive_load"), F.when(empty, 0.0).otherwise(rounded(score)).alias("dx_score"))
