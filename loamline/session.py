"""Session settings for local runs and tests; on a cluster the submitter's settings hold."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "loamline", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.appName(name)
        .master(f"local[{cpus or os.cpu_count()}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
