"""Source files made from the part table, for tables that hold no code: loops, branches, fields and
methods follow p_size, so plain SQL knows what the readers should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .star import read


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path and source: a Python file a part, and a Java file for every third. Parts are dealt out
    before they become text, as millions of them are one split of a Parquet file."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("int").alias("s"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    k, s = F.col("k").cast("string"), F.col("s")
    times = lambda n, text: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i > 0, F.replace(F.lit(text), F.lit("#"), i.cast("string"))).otherwise("")), "")
    python = F.concat(
        F.lit("import part_"), ((F.col("k") % 50) + 1).cast("string"), F.lit("\n\n\ndef run(x):\n"),
        times(s % 7, "    if x > #:\n        x += 1\n"), times(s % 3, "    for i in range(#):\n        x += i\n"), F.lit("    return x\n\n\nclass Item"), k, F.lit(":\n    kind = 0\n"),
        times(s % 5, "    f# = 0\n"), times(s % 4, "\n    def act#(self):\n        if self.kind:\n            return #\n"), times(s % 6, "\n    def get#(self):\n        return self.f#\n"),
    )
    java = F.concat(
        F.lit("import shop.Part"), ((F.col("k") % 50) + 1).cast("string"), F.lit(";\npublic class Part"), k, F.lit(" {\n    int kind;\n"), times(s % 5, "    int f#;\n"),
        times(s % 4, "    int act#() { if (this.kind > 0 && this.kind < 9) { return #; } return 0; }\n"), F.lit("    int getKind() { return this.kind; }\n}\n"),
    )
    a = parts.select(F.concat(F.lit("src/part_"), k, F.lit(".py")).alias("file_path"), python.alias("source"))
    b = parts.where("k % 3 = 0").select(F.concat(F.lit("src/Part"), k, F.lit(".java")).alias("file_path"), java.alias("source"))
    return a.unionByName(b)
