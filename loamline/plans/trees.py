"""The registered queries over source trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import code
from ..sources import made
from .oracle import rounded


def files(spark: SparkSession, d: str) -> DataFrame:
    return code.sources(made.tree(spark, d))


def read(spark: SparkSession, d: str, *want: str) -> DataFrame:
    """The files parsed, with the lists that the query wants of the reader."""
    return code.parsed(files(spark, d), want)


def lang(name: str, part: str, what):
    """Only the language's files are parsed."""
    return lambda s, d: what(code.parsed(files(s, d).where(f"lang = '{name}'"), (part,)))


CLASS_COLUMNS = ["file_path", "class_name", "field_count", "method_count", "behavior_method_count", "dunder_method_count", "property_count", "dbsi", "logic_density", "orchestration_pressure", "ams"]
FUNCTION_COLUMNS = ["file_path", "function_name", "class_name", "length", "cyclomatic_complexity", "max_nesting_depth", "branch_count", "exception_paths", "cognitive_complexity"]

QUERIES = {
    "list_sources": lambda s, d: files(s, d).select("file_path", "lang").orderBy("file_path"),
    "sources_union": lambda s, d: read(s, d).select("file_path", "lang", "readable"),
    "py_functions": lang("python", "functions", lambda r: code.functions(r).select(*FUNCTION_COLUMNS)),
    "java_functions": lang("java", "functions", lambda r: code.functions(r).select(*FUNCTION_COLUMNS)),
    "py_classes": lang("python", "classes", lambda r: code.classes(r).select(*CLASS_COLUMNS)),
    "java_classes": lang("java", "classes", lambda r: code.classes(r).select(*CLASS_COLUMNS)),
    "file_complexity": lambda s, d: code.file_complexity(code.functions(read(s, d, "functions"))),
    "complexity_report": lambda s, d: code.complexity_report(code.functions(read(s, d, "functions"))),
    "complexity_high": lambda s, d: code.functions(read(s, d, "functions")).where("cyclomatic_complexity > 6").select("file_path", "function_name", "cyclomatic_complexity"),
    "touch_counts": lambda s, d: code.touch_counts(read(s, d, "imports"), files(s, d)),
    "anemic_files": lambda s, d: code.anemic_files(read(s, d, "classes", "imports"), files=files(s, d)),
    "anemic_report": lambda s, d: code.anemic_report(read(s, d, "classes"), files=files(s, d)),
    "god_class_raw": lambda s, d: code.class_sizes(read(s, d, "classes")),
    "tcc": lambda s, d: code.class_sizes(read(s, d, "classes")).select("file_path", "class_name", "cohesion"),
    "god_classes": lambda s, d: code.god_classes(read(s, d, "classes")),
    "top_god_classes": lambda s, d: code.god_classes(read(s, d, "classes")).orderBy("god_class_score", "file_path", ascending=[False, True]).limit(20),
    "god_class_files": lambda s, d: code.god_class_files(code.god_classes(read(s, d, "classes"))),
    "god_class_report": lambda s, d: code.god_class_report(files(s, d), code.god_classes(read(s, d, "classes"))),
}

# Python: run() has s%7 ifs and s%3 loops; Item has 1 + s%5 fields, s%4 acting and s%6 reading methods.
# Java: Part has 1 + s%5 fields, s%4 acting methods with two conditions, and one accessor.
BASE = """WITH p AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s FROM part),
files AS (SELECT 'src/part_' || k || '.py' AS file_path, 'python' AS lang, k, s FROM p UNION ALL SELECT 'src/Part' || k || '.java', 'java', k, s FROM p WHERE k % 3 = 0),
f AS (
  SELECT file_path, lang, 'run' AS function_name, NULL AS class_name, 0 AS ord, 2 + 2 * (s % 7) + 2 * (s % 3) AS length, 1 + s % 7 + s % 3 AS cyclomatic_complexity, CASE WHEN s % 7 + s % 3 > 0 THEN 1 ELSE 0 END AS max_nesting_depth, s % 7 AS branch_count, s % 7 + s % 3 AS cognitive_complexity FROM files WHERE lang = 'python'
  UNION ALL SELECT file_path, lang, 'act' || i, 'Item' || k, 10 + i, 3, 2, 1, 1, 1 FROM files, range(1, 4) r(i) WHERE lang = 'python' AND i <= s % 4
  UNION ALL SELECT file_path, lang, 'get' || i, 'Item' || k, 20 + i, 2, 1, 0, 0, 0 FROM files, range(1, 6) r(i) WHERE lang = 'python' AND i <= s % 6
  UNION ALL SELECT file_path, lang, 'act' || i, 'Part' || k, i, 1, 3, 1, 1, 2 FROM files, range(1, 4) r(i) WHERE lang = 'java' AND i <= s % 4
  UNION ALL SELECT file_path, lang, 'getKind', 'Part' || k, 9, 1, 1, 0, 0, 0 FROM files WHERE lang = 'java'),
c0 AS (
  SELECT file_path, lang, k, s, 'Item' || k AS class_name, 1 + s % 5 AS field_count, s % 4 + s % 6 AS method_count, s % 4 AS acts, s % 4 + s % 6 AS cand, 0 AS property_count, 2 * (s % 4) + s % 6 AS wmc,
    ((s % 4) * (s % 4 - 1)) // 2 AS joined, ((s % 4 + s % 6) * (s % 4 + s % 6 - 1)) // 2 AS pairs FROM files WHERE lang = 'python'
  UNION ALL SELECT file_path, lang, k, s, 'Part' || k, 1 + s % 5, s % 4 + 1, s % 4, s % 4, 1, 3 * (s % 4) + 1, ((s % 4) * (s % 4 - 1)) // 2, ((s % 4) * (s % 4 - 1)) // 2 FROM files WHERE lang = 'java'),
""" + f"""c1 AS (SELECT *, {rounded('CAST(field_count AS DOUBLE) / (field_count + acts)')} AS dbsi, CASE WHEN cand > 0 THEN {rounded('CAST(acts AS DOUBLE) / cand')} ELSE 0.0 END AS logic_density FROM c0),
c2 AS (SELECT *, {rounded('1.0 - logic_density')} AS orchestration_pressure FROM c1),
c AS (SELECT *, {rounded('dbsi * orchestration_pressure')} AS ams FROM c2),
target AS (SELECT lang, k, file_path FROM files),
imp AS (SELECT t.file_path, count(*) AS n FROM files i JOIN target t ON t.lang = i.lang AND t.k = i.k % 50 + 1 WHERE t.k <> i.k GROUP BY t.file_path),
touch AS (SELECT files.file_path, coalesce(n, 0) AS touch_count FROM files LEFT JOIN imp USING (file_path)),
g0 AS (SELECT file_path, class_name, cand AS method_count, field_count, wmc AS total_complexity, CASE WHEN pairs > 0 THEN {rounded('CAST(joined AS DOUBLE) / pairs')} ELSE 1.0 END AS cohesion FROM c0),
g AS (SELECT *, {rounded(" + ".join(f"(CAST({x} - min({x}) OVER () AS DOUBLE) / (max({x}) OVER () - min({x}) OVER ())) * {w}" for x, w in (("method_count", 0.3), ("total_complexity", 0.3), ("field_count", 0.2))) + " + (1.0 - cohesion) * 0.2")} AS god_class_score FROM g0)
"""
_F = "SELECT file_path, function_name, class_name, length, cyclomatic_complexity, max_nesting_depth, branch_count, 0 AS exception_paths, cognitive_complexity FROM f"
_C = "SELECT file_path, class_name, field_count, method_count, acts AS behavior_method_count, 0 AS dunder_method_count, property_count, dbsi, logic_density, orchestration_pressure, ams FROM c"

ORACLE_SQL = {
    "list_sources": BASE + "SELECT file_path, lang FROM files ORDER BY file_path",
    "sources_union": BASE + "SELECT file_path, lang, true AS readable FROM files",
    "py_functions": BASE + _F + " WHERE lang = 'python'",
    "java_functions": BASE + _F + " WHERE lang = 'java'",
    "py_classes": BASE + _C + " WHERE lang = 'python'",
    "java_classes": BASE + _C + " WHERE lang = 'java'",
    "file_complexity": BASE
    + f"SELECT file_path, count(*) AS function_count, CAST(sum(cyclomatic_complexity) AS BIGINT) AS total_complexity, {rounded('avg(cyclomatic_complexity)', 2)} AS avg_complexity, max(cyclomatic_complexity) AS max_complexity, arg_min(function_name, (-cyclomatic_complexity, ord)) AS worst_function, {rounded('avg(length)', 2)} AS avg_length, max(length) AS max_length, max(max_nesting_depth) AS max_nesting, {rounded('avg(cognitive_complexity)', 2)} AS avg_cognitive, max(cognitive_complexity) AS max_cognitive FROM f GROUP BY file_path",
    "complexity_report": BASE
    + f"SELECT count(DISTINCT file_path) AS total_files, count(*) AS total_functions, {rounded('avg(cyclomatic_complexity)', 2)} AS avg_complexity, max(cyclomatic_complexity) AS max_complexity, count(*) FILTER (cyclomatic_complexity > 10) AS high_complexity_count, {rounded('avg(length)', 2)} AS avg_length, max(length) AS max_length, {rounded('avg(cognitive_complexity)', 2)} AS avg_cognitive, max(cognitive_complexity) AS max_cognitive FROM f",
    "complexity_high": BASE + "SELECT file_path, function_name, cyclomatic_complexity FROM f WHERE cyclomatic_complexity > 6",
    "touch_counts": BASE + "SELECT * FROM touch",
    "anemic_files": BASE + "SELECT file_path, count(*) AS class_count, count(*) FILTER (ams > 0.5) AS anemic_class_count, max(ams) AS worst_ams, any_value(touch_count) AS touch_count FROM c JOIN touch USING (file_path) GROUP BY file_path",
    "anemic_report": BASE + f"SELECT count(DISTINCT file_path) AS total_files, count(*) AS total_classes, count(*) FILTER (ams > 0.5) AS anemic_count, {rounded('CAST(count(*) FILTER (ams > 0.5) AS DOUBLE) / count(*) * 100', 1)} AS anemic_percentage, {rounded('avg(ams)')} AS average_ams FROM c",
    "god_class_raw": BASE + "SELECT * FROM g0",
    "tcc": BASE + "SELECT file_path, class_name, cohesion FROM g0",
    "god_classes": BASE + "SELECT * FROM g",
    "top_god_classes": BASE + "SELECT * FROM g ORDER BY god_class_score DESC, file_path LIMIT 20",
    "god_class_files": BASE + "SELECT file_path, count(*) AS class_count, count(*) FILTER (god_class_score > 0.6) AS god_class_count, max(god_class_score) AS worst_gcs FROM g GROUP BY file_path",
    "god_class_report": BASE + f"SELECT count(DISTINCT file_path) AS total_files, count(*) AS total_classes, count(*) FILTER (god_class_score > 0.6) AS god_class_count, {rounded('CAST(count(*) FILTER (god_class_score > 0.6) AS DOUBLE) / count(*) * 100', 1)} AS god_class_percentage, {rounded('avg(god_class_score)')} AS average_gcs FROM g",
}
