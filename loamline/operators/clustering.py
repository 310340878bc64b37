"""Commits by shape: features, scaling, k-means, silhouette, labels, drift.

Commits are many but their features are few different triples, so distances are worked out once for each
different triple and counted as often as it occurs. The driver holds the triples, and for the seeds of
k-means the number of each commit's triple in log order, at every size.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numeric import min_max, moment, ratio, rounded, rounded_signed
from .activity import churn, in_window

FEATURES = ("file_count", "total_churn", "add_ratio")
SEED, MAX_K, ROUNDS = 42, 8, 100
#: Distances that silhouette holds at a time.
HELD = 1 << 22


def commit_features(changes: DataFrame) -> DataFrame:
    per = changes.groupBy("commit_hash").agg(F.min("date").alias("date"), F.countDistinct("file_path").alias("file_count"), F.sum(churn()).alias("total_churn"), F.sum("lines_added").alias("added"))
    return per.select("commit_hash", "date", "file_count", "total_churn", rounded(ratio(F.col("added"), F.col("total_churn"))).alias("add_ratio"))


def normalized(features: DataFrame, columns=FEATURES) -> DataFrame:
    """features with each column scaled to [0, 1], as n_<column>. The range is one broadcast row."""
    span = features.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    met = features.join(F.broadcast(span))
    return met.select(*features.columns, *(min_max(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")).alias(f"n_{c}") for c in columns))


def assigned(points: DataFrame, centroids: list[list[float]], columns=("n_file_count", "n_total_churn", "n_add_ratio")) -> DataFrame:
    """points with the number of the nearest centroid in ``cluster``, the lowest of equally near ones."""
    far = [F.sqrt(reduce(lambda a, b: a + b, ((F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) for c, m in zip(columns, centroid, strict=True)))) for centroid in centroids]
    if len(far) == 1:
        return points.withColumn("cluster", F.lit(0))
    return points.withColumn("cluster", (F.array_position(F.array(*far), F.least(*far)) - 1).cast("int"))


def label(n_files, n_churn, n_ratio):
    """The first rule that fits names a cluster by its scaled centroid."""
    low = (n_churn < 0.3) & (n_files < 0.3)
    return (
        F.when((n_ratio >= 0.6) & (n_churn >= 0.5), "feature")
        .when(low & (n_ratio < 0.6), "config")
        .when(low, "bugfix")
        .when((n_files >= 0.5) & (n_ratio >= 0.3) & (n_ratio < 0.6), "refactoring")
        .otherwise("mixed")
    )


def summaries(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """cluster_id, label, size and the centroid of each cluster that has commits. points has cluster."""
    spark = points.sparkSession
    held = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centroids)], "cluster int, file_count double, total_churn double, add_ratio double")
    named = normalized(held) if len(centroids) > 1 else held.withColumns({f"n_{c}": F.lit(0.0) for c in FEATURES})
    sizes = points.groupBy("cluster").agg(F.count("*").alias("size"))
    met = sizes.join(F.broadcast(named), "cluster")
    return met.select(F.col("cluster").alias("cluster_id"), label(F.col("n_file_count"), F.col("n_total_churn"), F.col("n_add_ratio")).alias("label"), "size", *(rounded(F.col(c), 6).alias(f"centroid_{c}") for c in FEATURES))


def drift(points: DataFrame, named: DataFrame, now: str, days: int) -> DataFrame:
    """Each cluster's share of the commits before and from the window's middle, and where it is going."""
    middle = F.unix_micros(moment(now)) - int(days * 86_400_000_000 // 2)
    first = F.unix_micros("date") < middle
    per = points.groupBy("cluster").agg(F.count_if(first).alias("before"), F.count_if(~first).alias("after"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c: ratio(F.col(c), F.sum(c).over(whole)) * 100
    per = per.select("cluster", share("before").alias("a"), share("after").alias("b"))
    moved = rounded_signed(F.col("b") - F.col("a"), 1)
    trend = F.when(F.abs(moved) < 5.0, "stable").when(moved >= 5.0, "growing").otherwise("shrinking")
    met = per.join(F.broadcast(named.select("cluster_id", "label")), per["cluster"] == F.col("cluster_id"))
    return met.select("cluster_id", F.col("label").alias("cluster_label"), rounded(F.col("a"), 1).alias("first_half_pct"), rounded(F.col("b"), 1).alias("second_half_pct"), moved.alias("drift"), trend.alias("trend"))


# --- the numeric kernel, over different triples and their counts ---


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    best, at = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    for i, c in enumerate(centroids):
        d = np.sqrt(((points - c) ** 2).sum(1))
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return at


def seeds(points: np.ndarray, order: np.ndarray, k: int, rng: random.Random) -> np.ndarray:
    """k-means++: order holds, for each commit in turn, the number of its triple."""
    n = len(order)
    chosen = [points[order[rng.randrange(n)]]]
    while len(chosen) < k:
        if len(chosen) >= n:
            chosen.append(chosen[-1])
            continue
        d2 = np.min([((points - c) ** 2).sum(1) for c in chosen], axis=0)[order]
        rising = np.cumsum(d2)
        if rising[-1] == 0:
            chosen.append(points[order[rng.randrange(n)]])
            continue
        at = int(np.searchsorted(rising, rng.random() * rising[-1], "left"))
        chosen.append(points[order[min(at, n - 1)]])
    return np.array(chosen)


def kmeans(points: np.ndarray, counts: np.ndarray, order: np.ndarray, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and each triple's cluster. Stops when no triple moves; an empty cluster keeps its place."""
    centroids = seeds(points, order, k, random.Random(seed))
    before = None
    for _ in range(ROUNDS):
        at = nearest(points, centroids)
        if before is not None and (at == before).all():
            break
        before = at
        for i in range(k):
            mine = at == i
            if mine.any():
                centroids[i] = (points[mine] * counts[mine, None]).sum(0) / counts[mine].sum()
    return centroids, before


def silhouette(points: np.ndarray, counts: np.ndarray, cluster: np.ndarray, block: int | None = None) -> float:
    """Mean silhouette over all commits. One cluster, or only clusters of one commit, give 0; a commit
    alone in its cluster among larger ones has no distance to its own and counts 1."""
    names, at = np.unique(cluster, return_inverse=True)
    if len(names) < 2:
        return 0.0
    size = np.bincount(at, counts)
    if size.max() <= 1:
        return 0.0
    member = np.zeros((len(points), len(names)))
    member[np.arange(len(points)), at] = counts
    total, block = 0.0, block or max(1, min(1024, HELD // len(points)))
    for i in range(0, len(points), block):
        part, own = points[i : i + block], at[i : i + block]
        far = np.sqrt(((part[:, None, :] - points[None, :, :]) ** 2).sum(2)) @ member
        rows = np.arange(len(part))
        a = np.where(size[own] > 1, far[rows, own] / np.maximum(size[own] - 1, 1), 0.0)
        mean = far / size
        mean[rows, own] = np.inf
        b = mean.min(1)
        top = np.maximum(a, b)
        total += float((np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0) * counts[i : i + block]).sum())
    return total / counts.sum()


def choose_k(points: np.ndarray, counts: np.ndarray, order: np.ndarray, seed: int = SEED) -> int:
    n = len(order)
    if n <= 2:
        return 2
    scores = {k: silhouette(points, counts, kmeans(points, counts, order, k, seed)[1]) for k in range(2, min(MAX_K, n) + 1)}
    return max(scores, key=lambda k: (scores[k], -k))


def triples(scaled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different scaled triples, how many commits have each, and the triples' numbers in log order."""
    names = [f"n_{c}" for c in FEATURES]
    per = scaled.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names)
    got = per.toPandas()
    points, counts = got[names].to_numpy(float), got["n"].to_numpy(np.int64)
    at = {tuple(p): i for i, p in enumerate(points.tolist())}
    log = scaled.orderBy(F.desc("date"), "commit_hash").select(*names).toLocalIterator()
    order = np.fromiter((at[tuple(map(float, r))] for r in log), np.int32)
    return points, counts, order


def clusters(changes: DataFrame, now: str, days: int, k: int | None = None) -> dict:
    """All of the analysis: k, silhouette, centroids, and the frames points (features with cluster),
    summaries and drift. No commit gives k 0; a single one is a cluster of its own, labelled by zeros."""
    features = commit_features(in_window(changes, now, days))
    scaled = normalized(features)
    points, counts, order = triples(scaled)
    if not len(points):
        return {"k": 0, "silhouette": 0.0, "centroids": [], "points": scaled.withColumn("cluster", F.lit(0)), "summaries": None, "drift": None}
    if len(order) == 1:
        only = scaled.withColumn("cluster", F.lit(0))
        row = only.select(F.lit(0).alias("cluster_id"), F.lit("config").alias("label"), F.lit(1).cast("long").alias("size"), *(F.col(c).cast("double").alias(f"centroid_{c}") for c in FEATURES))
        return {"k": 1, "silhouette": 0.0, "centroids": [], "points": only, "summaries": row, "drift": None}
    k = k or choose_k(points, counts, order)
    centroids, cluster = kmeans(points, counts, order, k)
    placed = assigned(scaled, centroids.tolist())
    named = summaries(placed, centroids.tolist())
    return {"k": k, "silhouette": round(silhouette(points, counts, cluster), 4), "centroids": centroids.tolist(), "points": placed, "summaries": named, "drift": drift(placed, named, now, days)}
