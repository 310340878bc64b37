"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, pick

#: The remainder of crc32(id as text) by FOLDS that is held out: its labels are never learned from.
FOLDS, HELD_OUT = 3, 1


def fold(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(id_col):
    return fold(id_col) == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, turn) of at most ``bound`` labelled rows outside the held-out fold, those whose
    ids hash lowest; turn is that hash. Null ids, and labels other than 0 and 1, are left out; an id with
    both labels gives a row of each. Only the ids' list, bounded by ``bound``, is broadcast."""
    known = pick(labels, id=id_col, label=label_col).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(~held_out(F.col("id"))).select("id", F.col("label").cast("int").alias("label")).distinct()
    few = cut(known.withColumn("turn", F.xxhash64(F.col("id").cast("string"))).orderBy("turn", "label").limit(bound))
    return pick(docs, id=id_col, text=text_col).join(F.broadcast(few), "id")
