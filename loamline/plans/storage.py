"""The registered queries that write and read: parsed log text, and the run store."""

from __future__ import annotations

import tempfile
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import numstat, star
from ..sources.runs import RunStore
from . import history
from .oracle import hot, log


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The change log as text lines: sixteen logs, with rows that a reader must leave out."""
    rows = star.changes(spark, d, names=True)
    which = (F.col("commit_hash") % 16).cast("string")
    head = rows.groupBy("commit_hash").agg(F.first("date").alias("date"), F.first("author_name").alias("name"), F.first("author_email").alias("mail"))
    head = head.select(which.alias("log"), F.col("commit_hash").alias("place"), F.concat(F.lit(numstat.MARK), "commit_hash", F.lit(" "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss+00:00"), F.lit(" "), F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" "), "mail", F.lit("@x")).alias("line"), F.lit(0).alias("rank"))
    k = F.col("file_path")
    ending = F.when(k % 10 == 0, ".md").otherwise(".py")
    counts = F.when(k % 11 == 0, "-\t-").when(k % 13 == 0, F.col("lines_added").cast("string")).otherwise(F.concat_ws("\t", "lines_added", "lines_deleted"))
    body = rows.select(which.alias("log"), F.col("commit_hash").alias("place"), F.concat(counts, F.lit("\tsrc/f"), k, ending).alias("line"), F.lit(1).alias("rank"))
    every = head.unionByName(body)
    return every.select("log", (F.col("place") * 100 + F.row_number().over(_by())).alias("place"), "line")


def _by():
    from pyspark.sql import Window

    return Window.partitionBy("log", "place").orderBy("rank", "line")


def parse_numstat(spark: SparkSession, d: str) -> DataFrame:
    return numstat.parse(log_lines(spark, d))


def store(spark: SparkSession) -> RunStore:
    """A new store, in the folder that the cluster shares."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="loamline-runs-")
    return RunStore(spark, f"{shared}/runs-{uuid4().hex}")


def saved(spark: SparkSession, d: str) -> RunStore:
    """Two runs, of the two ends of the comparison."""
    out = store(spark)
    for name, now, score in (("before", history.BEFORE, 0.25), ("after", star.NOW, 0.75)):
        at = datetime.fromisoformat(now).replace(tzinfo=UTC)
        out.save(name, {"repo_path": "orders", "created_at": at, "to_date": at, "window_days": star.DAYS, "total_commits": 1, "dx_score": score, "avg_complexity": score * 4}, {"hotspot_files": history.hotspots(spark, d, now)})
    return out


QUERIES = {
    "parse_numstat": parse_numstat,
    "save_run_roundtrip": lambda s, d: saved(s, d).child("hotspot_files", "after").drop("run_id"),
    "list_runs": lambda s, d: saved(s, d).list_runs().select("run_id", "repo_path", "window_days", "total_commits"),
    "list_repos": lambda s, d: saved(s, d).list_repos(),
    "compare_runs": lambda s, d: saved(s, d).compare("before", "after").select("run_a", "run_b", F.explode("deltas").alias("field", "delta")),
}

ORACLE_SQL = {
    "parse_numstat": "WITH " + log()
    + " SELECT CAST(commit_hash AS VARCHAR) AS commit_hash, date, replace(author_name, '#', ' ') AS author_name, author_email || '@x' AS author_email, 'src/f' || file_path || '.py' AS file_path, lines_added, lines_deleted FROM changes WHERE file_path % 10 <> 0 AND file_path % 11 <> 0 AND file_path % 13 <> 0",
    "save_run_roundtrip": "WITH " + log() + ", " + hot() + " SELECT * FROM hot",
    "list_runs": "SELECT * FROM (VALUES ('after', 'orders', 365, 1), ('before', 'orders', 365, 1)) v(run_id, repo_path, window_days, total_commits)",
    "list_repos": "SELECT 'orders' AS repo_path",
    "compare_runs": "SELECT 'before' AS run_a, 'after' AS run_b, field, CASE field WHEN 'dx_score' THEN 0.5 WHEN 'complexity_avg' THEN 2.0 ELSE 0.0 END AS delta FROM (VALUES ('dx_score'), ('dx_throughput'), ('dx_feedback_delay'), ('dx_focus_ratio'), ('dx_cognitive_load'), ('complexity_avg'), ('anemic_anemic_pct'), ('effort_model_r_squared'), ('clustering_silhouette'), ('god_class_god_pct')) v(field)",
}
