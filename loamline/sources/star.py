"""The star-schema tables read as a change log: an order is a commit, a part a file, a customer an author."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The window that the registered queries look at.
NOW, DAYS = "2001-08-01", 365


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str, names: bool = False) -> DataFrame:
    """One row a changed file: commit_hash, date, file_path, lines_added, lines_deleted, author_email and,
    if asked for, author_name (a join that most analyses don't need)."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    log = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("commit_hash"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.col("l_partkey").alias("file_path"),
        F.col("l_quantity").cast("bigint").alias("lines_added"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("bigint").alias("lines_deleted"),
        F.col("o_custkey").alias("author_email"),
    )
    if not names:
        return log
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("author_email"), F.col("c_name").alias("author_name"))
    return log.join(people, "author_email")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path and file_size; every tenth file has none."""
    return read(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("file_path"), F.col("p_size").cast("bigint").alias("file_size"))
