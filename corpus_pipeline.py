"""The corpus pipeline: toxic rows go, one of each group of near copies stays, benchmark leaks go, personal
numbers become pseudonyms, and sources are mixed to their weights. Each stage gets what the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import decontaminate, mixing, pii, simhash, toxicity
from loamline.llm.base import checkpoint_dir, table

#: The key of the registered run; a real run passes its own secret to pii.with_pseudonyms.
PII_KEY = b"registered query, not a secret"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least 0.7 go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity about 0.8), the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def hide_numbers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Checked personal values become pseudonyms; nothing else of a row changes."""
    return pii.with_pseudonyms(docs, PII_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, numbered in column copy."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("pii", hide_numbers),
    ("mixing to target weights", mix_sources),
]

#: Trees, fingerprints and Feistel rounds have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again."""
    from uuid import uuid4

    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = hadoop(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
