"""All analyses of one repository in one go, from one reading of its log and sources."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, clustering, code, compare, coupling, effort, experience, knowledge
from ..sources.runs import RunStore


class Analysis:
    """Frames are made when first asked for; the log and the parsed sources are kept between them."""

    def __init__(self, spark: SparkSession, changes: DataFrame, sizes: DataFrame, sources: DataFrame, now: datetime | None = None, days: int = 90, repo_path: str = ""):
        at = now or datetime.now(UTC)
        self.spark, self.days, self.repo_path, self.at = spark, days, repo_path, at
        self.now = at.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        self.changes, self.sizes = changes.persist(), sizes
        self.read = code.parsed(code.sources(sources)).persist()

    def hotspots(self, now: str | None = None) -> DataFrame:
        return activity.hotspots(self.changes, self.sizes, now or self.now, self.days)

    def knowledge(self) -> DataFrame:
        return knowledge.files(self.changes, self.now, self.days)

    def pairs(self) -> DataFrame:
        return coupling.pairs(self.changes, self.now, self.days)

    def pain(self) -> DataFrame:
        return coupling.pain(self.changes, self.pairs(), self.now, self.days)

    def density(self) -> DataFrame:
        return activity.commit_density(self.changes, self.now, self.days)

    def clusters(self, k: int | None = None) -> dict:
        return clustering.clusters(self.changes, self.now, self.days, k)

    def effort(self, alpha: float | None = None) -> dict:
        rows = effort.scaled(effort.proxy(effort.features(self.hotspots(), self.knowledge(), self.pain()), self.density()), effort.NAMES).persist()
        alpha, beta, score = effort.fit(rows, alpha)
        return {"alpha": alpha, "coefficients": [round(float(b), 6) for b in beta], "r_squared": round(float(score), 4), "files": effort.files(rows, beta), "attributions": effort.attributions(rows, beta)}

    def experience(self, found: dict | None = None) -> tuple[DataFrame, DataFrame]:
        found = found or self.clusters()
        named = found["summaries"]
        if named is None:
            named = self.spark.createDataFrame([], "cluster_id int, label string, size long")
        load = experience.cognitive_load(self.hotspots(), self.knowledge(), self.pain(), code.file_complexity(code.functions(self.read)))
        return experience.report(activity.total_commits(self.changes, self.now, self.days), named, self.hotspots(), self.density(), load, self.days), load

    def compared(self, before: datetime) -> DataFrame:
        return compare.compare_hotspots(self.hotspots(before.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")), self.hotspots())

    def save(self, store: RunStore) -> str:
        """Everything, under a new run id."""
        run_id = str(uuid4())
        found, weighed = self.clusters(), self.effort()
        report, load = self.experience(found)
        functions, classes, gods = code.functions(self.read), code.classes(self.read), code.god_classes(self.read)
        one = lambda df: (df.first() or {}).asDict()
        cx, an, gd, dx = one(code.complexity_report(functions)), one(code.anemic_report(self.read)), one(code.god_class_report(self.read, gods)), one(report)
        hot, known, pairs = self.hotspots().persist(), self.knowledge().persist(), self.pairs().persist()
        header = {
            "repo_path": self.repo_path, "window_days": self.days, "from_date": self.at - timedelta(days=self.days), "to_date": self.at, "total_commits": dx["total_commits"], "file_count": dx["total_files"], "hotspot_count": hot.count(),
            "developer_risk_index": knowledge.gini(self.changes, self.now, self.days).first()[0], "knowledge_island_count": known.where("is_knowledge_island").count(), "coupling_pair_count": pairs.count(),
            "class_count": an["total_classes"], "anemic_count": an["anemic_count"], "anemic_percentage": an["anemic_percentage"], "average_ams": an["average_ams"],
            **{k: cx[k] for k in ("total_functions", "avg_complexity", "max_complexity", "high_complexity_count", "avg_length", "max_length", "avg_cognitive", "max_cognitive")},
            "cluster_count": found["k"], "silhouette_score": float(found["silhouette"]), "effort_r_squared": weighed["r_squared"], "effort_alpha": float(weighed["alpha"]), "effort_coefficients": weighed["coefficients"],
            "dx_score": dx["dx_score"], "dx_throughput": dx["throughput"], "dx_feedback_delay": dx["feedback_delay"], "dx_focus_ratio": dx["focus_ratio"], "dx_cognitive_load": dx["cognitive_load"], "dx_weights": list(experience.PARTS),
            "god_class_count": gd["god_class_count"], "god_class_percentage": gd["god_class_percentage"], "average_gcs": gd["average_gcs"],
        }
        children = {"hotspot_files": hot, "knowledge_files": known, "coupling_pairs": pairs, "file_pain": self.pain(), "anemic_classes": classes, "complexity_functions": functions, "effort_files": weighed["files"], "dx_cognitive_files": load, "god_class_classes": gods}
        children |= {name: found[key] for name, key in (("cluster_summaries", "summaries"), ("cluster_drift", "drift")) if found[key] is not None}
        store.save(run_id, header, children)
        return run_id


def complexity_histogram(functions: DataFrame) -> DataFrame:
    return functions.groupBy("cyclomatic_complexity").agg(F.count("*").alias("n")).orderBy("cyclomatic_complexity")
