"""The run store: what each run found, as Parquet folders by run. A run counts once its marker is there,
which is written last, so a save that breaks off leaves nothing that a reader sees."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that a header has in any version; missing ones are filled when older runs are read.
HEADER = {
    "run_id": "string", "repo_path": "string", "created_at": "timestamp", "window_days": "int", "from_date": "timestamp", "to_date": "timestamp", "total_commits": "long", "file_count": "long", "hotspot_count": "long",
    "developer_risk_index": "double", "knowledge_island_count": "long", "coupling_pair_count": "long", "class_count": "long", "anemic_count": "long", "anemic_percentage": "double", "average_ams": "double",
    "total_functions": "long", "avg_complexity": "double", "max_complexity": "long", "high_complexity_count": "long", "avg_length": "double", "max_length": "long", "avg_cognitive": "double", "max_cognitive": "long",
    "cluster_count": "long", "silhouette_score": "double", "drift_count": "long", "effort_r_squared": "double", "effort_alpha": "double", "effort_coefficients": "array<double>",
    "dx_score": "double", "dx_throughput": "double", "dx_feedback_delay": "double", "dx_focus_ratio": "double", "dx_cognitive_load": "double", "dx_weights": "array<double>",
    "god_class_count": "long", "god_class_percentage": "double", "average_gcs": "double",
}
CHILDREN = ("hotspot_files", "knowledge_files", "coupling_pairs", "file_pain", "anemic_classes", "complexity_functions", "cluster_summaries", "cluster_drift", "effort_files", "dx_cognitive_files", "god_class_classes")
#: What compare() reports of two runs, b less a: name and column.
DELTAS = {
    "dx_score": "dx_score", "dx_throughput": "dx_throughput", "dx_feedback_delay": "dx_feedback_delay", "dx_focus_ratio": "dx_focus_ratio", "dx_cognitive_load": "dx_cognitive_load",
    "complexity_avg": "avg_complexity", "anemic_anemic_pct": "anemic_percentage", "effort_model_r_squared": "effort_r_squared", "clustering_silhouette": "silhouette_score", "god_class_god_pct": "god_class_percentage",
}


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def committed(self) -> list[str]:
        folder = f"{self.root}/committed"
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self._exists(folder) else []

    def save(self, run_id: str, header: dict, children: dict[str, DataFrame]) -> None:
        """All tables of a run, or none. A run_id that is there already, or a table that isn't known, is a
        ValueError; if a write fails, what was written of the run is removed."""
        if self._exists(f"{self.root}/committed/{run_id}"):
            raise ValueError(f"run {run_id} is there already")
        if unknown := (set(children) - set(CHILDREN)) | (set(header) - set(HEADER)):
            raise ValueError(f"unknown: {sorted(unknown)}")
        row = {"run_id": run_id, "created_at": datetime.now(UTC), **header}
        try:
            schema = ", ".join(f"{c} {t}" for c, t in HEADER.items())
            self._put("runs", run_id, self.spark.createDataFrame([tuple(row.get(c) for c in HEADER)], schema))
            for name, frame in children.items():
                self._put(name, run_id, frame)
            if not self._fs.mkdirs(self._path(f"{self.root}/committed/{run_id}")):
                raise OSError(f"no marker for {run_id}")
        except BaseException:
            for name in ("runs", *children):
                self._fs.delete(self._path(f"{self.root}/{name}/run_id={run_id}"), True)
            raise

    def _put(self, table: str, run_id: str, frame: DataFrame) -> None:
        kept = frame.drop("run_id")
        kept.write.mode("overwrite").parquet(f"{self.root}/{table}/run_id={run_id}")

    def _table(self, name: str) -> DataFrame | None:
        """All committed rows of a table, columns of any version."""
        if not self._exists(f"{self.root}/{name}"):
            return None
        # Ids are text: else Spark would read "007" in a folder's name as the number 7.
        guess, conf = "spark.sql.sources.partitionColumnTypeInference.enabled", self.spark.conf
        before = conf.get(guess)
        conf.set(guess, "false")
        try:
            frame = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}")
        finally:
            conf.set(guess, before)
        return frame.where(F.col("run_id").isin(self.committed()))

    def runs(self) -> DataFrame:
        found = self._table("runs")
        if found is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in HEADER.items()))
        have = set(found.columns)
        return found.select(*(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in HEADER.items()))

    def list_runs(self, repo_path: str | None = None) -> DataFrame:
        """Newest first; of one repository if it is named."""
        found = self.runs() if repo_path is None else self.runs().where(F.col("repo_path") == repo_path)
        return found.select("run_id", "repo_path", "created_at", "window_days", "from_date", "to_date", "total_commits").orderBy(F.desc("created_at"), "run_id")

    def get_run(self, run_id: str) -> dict | None:
        row = self.runs().where(F.col("run_id") == run_id).first()
        return row.asDict(recursive=True) if row else None

    def list_repos(self) -> DataFrame:
        return self.runs().select("repo_path").distinct().orderBy("repo_path")

    def child(self, name: str, run_id: str) -> DataFrame:
        """A run's rows of a child table, read from its own folder only. KeyError for a name or
        a run that isn't known; no rows if the run has none."""
        if name not in CHILDREN:
            raise KeyError(name)
        if run_id not in self.committed():
            raise KeyError(run_id)
        if not self._exists(f"{self.root}/{name}/run_id={run_id}"):
            return self.spark.createDataFrame([], "run_id string")
        return self.spark.read.parquet(f"{self.root}/{name}/run_id={run_id}").withColumn("run_id", F.lit(run_id))

    def compare(self, a: str, b: str) -> DataFrame:
        """One row: both ids and the differences as a map, rounded to six digits."""
        for x in (a, b):
            if x not in self.committed():
                raise KeyError(x)
        left, right = (self.runs().where(F.col("run_id") == x).select(*(F.col(c).alias(f"{s}_{c}") for c in ("run_id", *DELTAS.values()))) for s, x in (("a", a), ("b", b)))
        gap = lambda c: F.round((F.coalesce(f"b_{c}", F.lit(0)) - F.coalesce(f"a_{c}", F.lit(0))).cast("double"), 6)
        entries = F.create_map(*(x for name, c in DELTAS.items() for x in (F.lit(name), gap(c))))
        return left.join(right).select(F.col("a_run_id").alias("run_a"), F.col("b_run_id").alias("run_b"), entries.alias("deltas"))
