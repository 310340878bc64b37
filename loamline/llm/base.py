"""What the corpus operators share: column picking, Arrow maps, lineage cuts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken from an Arrow batch at a time, so that few long texts are Python objects at once.
SLICE_ROWS = 512
#: Spark's setting by which the shuffle files of an action go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def place_of(df: DataFrame, name: str) -> int:
    """Where the column is. Exact spelling wins over one that differs in case; none raises KeyError."""
    at = [i for i, x in enumerate(df.columns) if x == name] or [i for i, x in enumerate(df.columns) if x.lower() == name.lower()]
    if not at:
        raise KeyError(f"no column {name!r} among {df.columns}")
    return at[0]


def plain(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...; no extra column can clash with a working one. toDF() undoes it."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The columns named by the values, renamed to the keys; other columns go, so extra columns such as
    ``TEXT`` beside ``text`` make no reference ambiguous."""
    return plain(df).select(*(F.col(f"c{place_of(df, name)}").alias(alias) for alias, name in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a session in one process (tests) may have none and gets a
    temporary one; elsewhere executors would not share it, which is an error."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loamline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written as Parquet in the shared folder and read from there, so that later steps
    neither repeat its plan nor lose it with an executor. Its shuffle files go as soon as it is written;
    drop() removes the table, the end of the application what is left."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/loamline-{uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    fs, path = _path(spark, at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of cut() that nothing reads any more."""
    for t in tables:
        fs, path = _path(t.sparkSession, t._cut_at)
        fs.delete(path, True)


def arrow_map(df: DataFrame, rows: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over slices of SLICE_ROWS rows. ``rows()`` runs once a task and returns the function
    from columns (name to list) to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = df.columns
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = each({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def scratch_dir() -> str:
    """A task's own scratch folder: local disk for spilled runs, removed by the task itself."""
    return tempfile.mkdtemp(prefix="loamline-")
