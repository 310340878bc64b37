"""Relative effort: six features a file, a ridge regression on an effort proxy, an index with its parts."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import min_max, rounded, rounded_signed

NAMES = ("code_churn", "change_frequency", "pain_score", "knowledge_concentration", "author_count", "knowledge_x_pain")
ALPHAS = (0.1, 0.5, 1.0, 2.0, 5.0)


def features(hotspots: DataFrame, known: DataFrame, pained: DataFrame) -> DataFrame:
    """One row a file of the hotspots; a file without knowledge has one author and no concentration."""
    met = hotspots.select("file_path", "code_churn", "change_frequency", "rework_ratio").join(known.select("file_path", "knowledge_concentration", "author_count"), "file_path", "left").join(pained.select("file_path", "pain_score"), "file_path", "left")
    fill = {"knowledge_concentration": 0.0, "author_count": 1, "pain_score": 0.0}
    met = met.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return met.select("file_path", "rework_ratio", *(F.col(c).cast("double").alias(c) for c in NAMES[:-1]), (F.col("knowledge_concentration") * F.col("pain_score")).alias(NAMES[-1]))


def scaled(rows: DataFrame, columns) -> DataFrame:
    """rows with z_<column>, each over its own range."""
    span = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    met = rows.join(F.broadcast(span))
    return met.select(*rows.columns, *(min_max(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")).alias(f"z_{c}") for c in columns))


def proxy(rows: DataFrame, density: DataFrame) -> DataFrame:
    """rows with commit_density, scaled density and rework, and proxy, the mean of the two."""
    met = rows.join(density, "file_path", "left").withColumn("commit_density", F.coalesce("commit_density", F.lit(1.0)))
    met = scaled(met, ("commit_density", "rework_ratio"))
    return met.withColumn("proxy", F.col("z_commit_density") * 0.5 + F.col("z_rework_ratio") * 0.5).drop("z_commit_density", "z_rework_ratio")


def normal_equations(rows: DataFrame) -> DataFrame:
    """One row: x<i><j> for i <= j, y<i>, and n, sum and sum of squares of the proxy. One pass."""
    z = [F.col(f"z_{c}") for c in NAMES]
    sums = [F.sum(z[i] * z[j]).alias(f"x{i}{j}") for i, j in combinations_with_replacement(range(6), 2)]
    return rows.agg(*sums, *(F.sum(z[i] * F.col("proxy")).alias(f"y{i}") for i in range(6)), F.count("*").alias("n"), F.sum("proxy").alias("sy"), F.sum(F.col("proxy") * F.col("proxy")).alias("syy"))


def solve(sums: dict, alpha: float) -> np.ndarray:
    x = np.array([[sums[f"x{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)], float)
    return np.linalg.solve(x + alpha * np.eye(6), np.array([sums[f"y{i}"] for i in range(6)], float))


def dot(beta):
    out = F.lit(0.0)
    for c, b in zip(NAMES, beta, strict=True):
        out = out + F.col(f"z_{c}") * F.lit(float(b))
    return out


def r_squared(rows: DataFrame, betas: list[np.ndarray]) -> list[float]:
    """Of each coefficient vector, in one pass for all of them after one for the mean; 0 for a constant proxy."""
    mean = rows.agg(F.avg("proxy")).first()[0]
    if mean is None:
        return [0.0] * len(betas)
    y = F.col("proxy")
    got = rows.agg(F.sum((y - F.lit(mean)) * (y - F.lit(mean))), *(F.sum((y - dot(b)) * (y - dot(b))) for b in betas)).first()
    return [1.0 - got[i + 1] / got[0] if got[0] else 0.0 for i in range(len(betas))]


def fit(rows: DataFrame, alpha: float | None = None) -> tuple[float, np.ndarray, float]:
    """alpha, coefficients and R squared; the best alpha in sample if none is given. Fewer than three
    files weigh all features alike."""
    sums = normal_equations(rows).first().asDict()
    if sums["n"] < 3:
        return alpha or 1.0, np.full(6, 1 / 6), 0.0
    tried = [alpha] if alpha is not None else list(ALPHAS)
    betas = [solve(sums, a) for a in tried]
    scores = r_squared(rows, betas)
    best = max(range(len(tried)), key=lambda i: (scores[i], -i))
    return tried[best], betas[best], scores[best]


def index(rows: DataFrame, beta) -> DataFrame:
    """rows with raw (the dot product) and rei_score, raw over its range."""
    met = rows.withColumn("raw", dot(beta))
    span = met.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return met.join(F.broadcast(span)).withColumn("rei_score", min_max(F.col("raw"), F.col("low"), F.col("high"))).drop("low", "high")


def files(rows: DataFrame, beta) -> DataFrame:
    return index(rows, beta).select("file_path", rounded(F.col("rei_score")).alias("rei_score"), rounded(F.col("proxy")).alias("proxy_label"), rounded(F.col("commit_density")).alias("commit_density"), rounded(F.col("rework_ratio")).alias("rework_ratio"))


def attributions(rows: DataFrame, beta) -> DataFrame:
    """One row a (file, feature): raw_value, weight, contribution, and its place by absolute size."""
    each = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("feature_name"), F.col(c).alias("raw_value"), rounded_signed(F.lit(float(b)), 6).alias("weight"), rounded_signed(F.col(f"z_{c}") * F.lit(float(b)), 6).alias("contribution")) for i, (c, b) in enumerate(zip(NAMES, beta, strict=True))))
    by_size = F.array_sort(F.transform(each, lambda x: F.struct((-F.abs(x["contribution"])).alias("order"), x["at"].alias("at"), x.alias("x"))))
    return rows.select("file_path", F.posexplode(by_size).alias("place", "e")).select("file_path", F.col("e.x.feature_name").alias("feature_name"), F.col("e.x.raw_value").alias("raw_value"), F.col("e.x.weight").alias("weight"), F.col("e.x.contribution").alias("contribution"), (F.col("place") + 1).alias("place"))
