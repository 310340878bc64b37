"""Source trees: one reading of each file feeds complexity, anemia, god classes and imports.

The reader runs once a file on the workers and returns all its rows as nested arrays; each analysis
explodes the part it needs, and a table that is kept serves them all.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.numeric import min_max, ratio, rounded

FUNCTION = "function_name string, class_name string, line_number long, length long, cyclomatic_complexity long, max_nesting_depth long, branch_count long, exception_paths long, cognitive_complexity long"
CLASS = "class_name string, line_number long, field_count long, method_count long, behavior_method_count long, candidate_count long, dunder_method_count long, property_count long, total_complexity long, joined_pairs long, method_pairs long"
PARTS = ("functions", "classes", "imports")
PARSED = {"functions": f"functions array<struct<{FUNCTION.replace(' ', ':').replace(',:', ',')}>>", "classes": f"classes array<struct<{CLASS.replace(' ', ':').replace(',:', ',')}>>", "imports": "imports array<string>"}
AMS, GCS, HIGH = 0.5, 0.6, 10


def sources(files: DataFrame) -> DataFrame:
    """file_path, lang and source of Python and Java files, by the path's ending; others go."""
    lang = F.when(F.col("file_path").endswith(".py"), "python").when(F.col("file_path").endswith(".java"), "java")
    return files.select("file_path", lang.alias("lang"), "source").where("lang is not null")


def parsed(files: DataFrame, want: tuple[str, ...] = PARTS) -> DataFrame:
    """What the reader says about each file. Only the wanted of its lists leave the reader, which judges by
    all of a file in any case whether it is readable."""
    ddl = ", ".join(["file_path string, lang string, readable boolean", *(PARSED[x] for x in PARTS if x in want)])
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        import gc

        from ..functions import java_code, python_code

        # Syntax trees are many objects without cycles; looking for cycles in each of them takes a fifth of the time.
        gc.disable()
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    rows = []
                    for path, lang, source in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                        got = (python_code if lang == "python" else java_code).read(source)
                        rows.append({"file_path": path, "lang": lang, "readable": got is not None, **{x: got[x] if got else [] for x in want}})
                    yield pa.RecordBatch.from_pylist(rows, schema)
                gc.collect()
        finally:
            gc.enable()

    return files.select("file_path", "lang", "source").mapInArrow(run, ddl)


def functions(read: DataFrame) -> DataFrame:
    return read.select("file_path", "lang", F.explode("functions").alias("f")).select("file_path", "lang", "f.*")


def classes(read: DataFrame) -> DataFrame:
    """One row a class, with its anemia: dbsi is the share of fields, pressure what methods lack in logic,
    and ams their product, each rounded before the next."""
    return _anemia(read.select("file_path", "lang", F.explode("classes").alias("c")).select("file_path", "lang", "c.*"))


def _anemia(each: DataFrame) -> DataFrame:
    acts = F.col("behavior_method_count")
    each = each.withColumn("dbsi", rounded(ratio(F.col("field_count"), F.col("field_count") + acts)))
    each = each.withColumn("logic_density", rounded(ratio(acts, F.col("candidate_count"))))
    each = each.withColumn("orchestration_pressure", rounded(1.0 - F.col("logic_density")))
    return each.withColumn("ams", rounded(F.col("dbsi") * F.col("orchestration_pressure")))


def file_complexity(rows: DataFrame) -> DataFrame:
    """One row a file that has functions. Of equally complex functions the first is the worst."""
    cc = F.col("cyclomatic_complexity")
    return rows.groupBy("file_path").agg(
        F.count("*").alias("function_count"),
        F.sum(cc).alias("total_complexity"),
        rounded(F.avg(cc), 2).alias("avg_complexity"),
        F.max(cc).alias("max_complexity"),
        F.max_by("function_name", F.struct(cc, -F.col("line_number"))).alias("worst_function"),
        rounded(F.avg("length"), 2).alias("avg_length"),
        F.max("length").alias("max_length"),
        F.max("max_nesting_depth").alias("max_nesting"),
        rounded(F.avg("cognitive_complexity"), 2).alias("avg_cognitive"),
        F.max("cognitive_complexity").alias("max_cognitive"),
    )


def complexity_report(rows: DataFrame, high: int = HIGH) -> DataFrame:
    cc = F.col("cyclomatic_complexity")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.agg(
        F.countDistinct("file_path").alias("total_files"),
        F.count("*").alias("total_functions"),
        zero(rounded(F.avg(cc), 2)).alias("avg_complexity"),
        F.coalesce(F.max(cc), F.lit(0)).alias("max_complexity"),
        F.count_if(cc > high).alias("high_complexity_count"),
        zero(rounded(F.avg("length"), 2)).alias("avg_length"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_length"),
        zero(rounded(F.avg("cognitive_complexity"), 2)).alias("avg_cognitive"),
        F.coalesce(F.max("cognitive_complexity"), F.lit(0)).alias("max_cognitive"),
    )


def _targets(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("file_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return files.groupBy("lang", name.alias("name")).agg(F.max("file_path").alias("target"))


def touch_counts(read: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """How many other files of the language import each file, by the name that its path ends in. Of files
    with one name the last path is meant. An import counts once a file. files: the same rows as they were
    before they were parsed, from which paths are taken without parsing."""
    files = read if files is None else files
    targets = _targets(files)
    wanted = read.select("lang", F.col("file_path").alias("importer"), F.explode(F.array_distinct("imports")).alias("name"))
    met = wanted.join(targets, ["lang", "name"]).where("target <> importer").groupBy("target").agg(F.count("*").alias("n"))
    return files.select("file_path").join(met, F.col("file_path") == F.col("target"), "left").select("file_path", F.coalesce("n", F.lit(0)).alias("touch_count"))


def anemic_files(read: DataFrame, limit: float = AMS, files: DataFrame | None = None) -> DataFrame:
    """One row a file. files: as for touch_counts(). Classes and imports go the same way, so that the parsed
    files are read once: both become rows that count for a file, a class for its own, an import for its target."""
    files = read if files is None else files
    kind = read.schema["classes"].dataType.elementType
    # No name of a file has a slash, so a class finds no target.
    own = F.transform("classes", lambda c: F.struct(c.alias("c"), F.concat(F.lit("/"), "file_path").alias("name")))
    wanted = F.transform(F.array_distinct("imports"), lambda i: F.struct(F.lit(None).cast(kind).alias("c"), i.alias("name")))
    rows = read.select("file_path", "lang", F.explode(F.concat(own, wanted)).alias("e")).select("file_path", "lang", "e.name", F.col("e.c").isNotNull().alias("own"), "e.c.*")
    rows = _anemia(rows).select("file_path", "lang", "name", "own", "ams").join(_targets(files), ["lang", "name"], "left")
    counted = rows.where("own or target <> file_path").groupBy(F.when(F.col("own"), F.col("file_path")).otherwise(F.col("target")).alias("of"))
    per = counted.agg(F.count_if("own").alias("class_count"), F.count_if(F.col("own") & (F.col("ams") > limit)).alias("anemic_class_count"), F.max(F.when(F.col("own"), F.col("ams"))).alias("worst_ams"), F.count_if(~F.col("own")).alias("touch_count"))
    met = files.select("file_path").join(per, F.col("file_path") == F.col("of"), "left")
    return met.select("file_path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("class_count", "anemic_class_count")), F.coalesce("worst_ams", F.lit(0.0)).alias("worst_ams"), F.coalesce("touch_count", F.lit(0)).alias("touch_count"))


def anemic_report(read: DataFrame, limit: float = AMS, files: DataFrame | None = None) -> DataFrame:
    """One row. files: as for touch_counts()."""
    bad, n = F.count_if(F.col("ams") > limit), F.count("*")
    of = classes(read).agg(n.alias("total_classes"), bad.alias("anemic_count"), rounded(ratio(bad, n) * 100, 1).alias("anemic_percentage"), F.coalesce(rounded(F.avg("ams")), F.lit(0.0)).alias("average_ams"))
    return (read if files is None else files).agg(F.count("*").alias("total_files")).join(of)


def class_sizes(read: DataFrame) -> DataFrame:
    """One row a class: methods, fields, complexity and cohesion."""
    return read.select("file_path", F.explode("classes").alias("c")).select(
        "file_path",
        "c.class_name",
        F.col("c.candidate_count").alias("method_count"),
        "c.field_count",
        "c.total_complexity",
        F.when(F.col("c.method_pairs") > 0, rounded(F.col("c.joined_pairs") / F.col("c.method_pairs"))).otherwise(1.0).alias("cohesion"),
    )


def god_classes(read: DataFrame) -> DataFrame:
    """class_sizes() with the score over all classes' ranges. All columns say where a class is dealt, so
    that none is pruned for the ranges: both uses then are of one exchange, and the files are parsed once."""
    each = class_sizes(read)
    each = each.repartition(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), *each.columns)
    names = ("method_count", "field_count", "total_complexity")
    span = each.agg(*(f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max))))
    part = {c: min_max(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")) for c in names}
    score = part["method_count"] * 0.3 + part["total_complexity"] * 0.3 + part["field_count"] * 0.2 + (1.0 - F.col("cohesion")) * 0.2
    return each.join(F.broadcast(span)).select(*each.columns, rounded(score).alias("god_class_score"))


def god_class_files(scored: DataFrame, limit: float = GCS) -> DataFrame:
    return scored.groupBy("file_path").agg(F.count("*").alias("class_count"), F.count_if(F.col("god_class_score") > limit).alias("god_class_count"), F.max("god_class_score").alias("worst_gcs"))


def god_class_report(read: DataFrame, scored: DataFrame, limit: float = GCS) -> DataFrame:
    """One row. Of read only the number of rows is asked, so files that aren't parsed will do."""
    bad, n = F.count_if(F.col("god_class_score") > limit), F.count("*")
    of = scored.agg(n.alias("total_classes"), bad.alias("god_class_count"), rounded(ratio(bad, n) * 100, 1).alias("god_class_percentage"), F.coalesce(rounded(F.avg("god_class_score")), F.lit(0.0)).alias("average_gcs"))
    return read.agg(F.count("*").alias("total_files")).join(of)
