"""Commit logs as text: a header line a commit, then a tab-separated line a file.

Lines are numbered by their place in the file; a file's lines are cut into stretches, each worked
through in order, and the header that holds at a stretch's start is the last one of the stretches before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

MARK = "COMMIT:"
STRETCH = 100_000


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """log, place and line of the files under path. A log is read as one value, as order is its meaning;
    split very large histories into several files, which keep their own headers."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), F.split("value", "\n").alias("lines"))
    return whole.select("log", F.posexplode("lines").alias("place", "line"))


def parse(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """commit_hash, date, author_name, author_email, file_path, lines_added, lines_deleted of each kept row.

    Left out: rows before any header, of other than three parts, with counts that aren't numbers (binary
    files), and files that end in .md. Names may have several words; the address is the last."""
    text = F.trim(F.regexp_replace("line", r"\r$", ""))
    each = lines.select("log", "place", text.alias("line"), F.floor(F.col("place") / stretch).alias("stretch")).where("line <> ''")
    header = F.when(F.col("line").startswith(MARK), F.col("line"))
    inside = F.last(header, ignorenulls=True).over(Window.partitionBy("log", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("log").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    ends = each.groupBy("log", "stretch").agg(F.max_by(header, F.when(header.isNotNull(), F.col("place"))).alias("last")).withColumn("carried", before)
    met = each.withColumn("header", inside).join(ends.select("log", "stretch", "carried"), ["log", "stretch"])
    rows = met.withColumn("header", F.coalesce("header", "carried")).where(~F.col("line").startswith(MARK) & F.col("header").isNotNull())
    words, parts = F.split(F.substr("header", F.lit(len(MARK) + 1)), " "), F.split("line", "\t", 3)
    got = rows.select("log", "place", words.alias("w"), parts.alias("p")).where(F.size("p") == 3)
    number = lambda k: F.get("p", F.lit(k)).try_cast("bigint")
    return got.select(
        F.get("w", F.lit(0)).alias("commit_hash"),
        F.try_to_timestamp(F.get("w", F.lit(1))).alias("date"),
        F.array_join(F.slice("w", 3, F.greatest(F.size("w") - 3, F.lit(0))), " ").alias("author_name"),
        F.element_at("w", -1).alias("author_email"),
        F.get("p", F.lit(2)).alias("file_path"),
        number(0).alias("lines_added"),
        number(1).alias("lines_deleted"),
    ).where("lines_added is not null and lines_deleted is not null and not endswith(file_path, '.md')")
