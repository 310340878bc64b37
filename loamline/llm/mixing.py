"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Each source's target words are its weight's share of all words, held at ``cap`` times what it has, the
excess going to the others by weight (water filling). A row's expected copies are its source's target
over its words. Rows are put in order of (source, size, id); the expected copies are summed along that
order, one offset a source is added, and a row is emitted once for each integer that its step of the
running sum crosses. Size order makes every stretch of like-sized rows give its share, so a source's
taken words miss the target by about the size of a row or two. The sums are whole numbers of 2**-32
copies, so neither partitioning nor retries change them. The running sum is made by range partitions:
sums within each, then the totals before it; a source with a third of all rows spans many partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import cut, pick, place_of, plain

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 32
WEIGHTS = (5, 2, 1)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, target) for rows of (source, size). One row a source is all that its
    windows see."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), ((nth - 1) % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", weight)
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("held", F.coalesce(F.sum(F.col("source_size") * cap).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("source_size") * cap * F.col("open") <= F.col("weight") * (F.col("total") - F.col("held")))
    )
    # Capped sources come first in this order; the first that isn't has the level of all others.
    level = F.max(F.when(~F.col("capped"), F.struct((F.col("total") - F.col("held")).alias("left"), F.col("open").alias("open"), -F.col("held")))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open")).alias("target"),
    )


def offset_units(source, seed: int):
    """The source's offset, in units of 2**-32 copies."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies and taken (copies times size) of each row.

    Null, empty and blank texts have size 0. A null source is a source, ordered last. Rows with a null id
    come first in their source's order of equal sizes; repeated rows take successive steps. A source
    without words has target 0 and no copies. An empty table gives an empty result.
    """
    rows = pick(docs, id=id_col, source=source_col, text=text_col)
    sizes = cut(rows.select("id", "source", word_count(F.col("text")).alias("size")))
    per = targets(sizes, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    per = cut(per.withColumn("step", rate).withColumnRenamed("source", "of"))
    dealt = cut(sizes.repartitionByRange("source", "size", "id").withColumn("part", F.spark_partition_id()))
    stepped = dealt.join(per, dealt["source"].eqNullSafe(per["of"])).drop("of")
    parts = stepped.groupBy("source", "part").agg(F.sum(F.col("step").cast("decimal(38,0)")).alias("steps"))
    before = F.sum("steps").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = (F.coalesce(before, F.lit(0)) + offset_units(F.col("source"), seed)) % F.lit(UNIT).cast("decimal(38,0)")
    base = parts.select(F.col("source").alias("of"), F.col("part").alias("at"), base.cast("long").alias("base"))
    run = F.sum("step").over(Window.partitionBy("source", "part").orderBy("size", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    summed = stepped.withColumn("run", run)
    met = summed.join(base, summed["source"].eqNullSafe(base["of"]) & (summed["part"] == base["at"]))
    end = F.col("base") + F.col("run")
    n = F.shiftright(end, 32) - F.shiftright(end - F.col("step"), 32)
    return met.select("id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken")).withColumnsRenamed({"id": id_col, "source": source_col})


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with each row as often as it is emitted, and its number among its copies in column ``copy``
    (from 1; a column of that name is replaced). Rows that are taken no time go. Nulls, ties and repeated
    rows as in copies()."""
    counted = cut(copies(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options))
    plan = counted.toDF("mix_id", "mix_source", "mix_size", *counted.columns[3:]).select("mix_id", "mix_source", "mix_size", F.col("copies").alias("mix_copies"))
    at_id, at_source, at_text = (f"c{place_of(docs, c)}" for c in (id_col, source_col, text_col))
    sized = plain(docs).withColumn("words", word_count(F.col(at_text)))
    same = sized[at_id].eqNullSafe(plan["mix_id"]) & sized[at_source].eqNullSafe(plan["mix_source"]) & (sized["words"] == plan["mix_size"])
    if not plan.groupBy("mix_id", "mix_source", "mix_size").count().where("count > 1").isEmpty():
        # Rows alike in all three are told apart by a number.
        plan = plan.withColumn("mix_nth", F.row_number().over(Window.partitionBy("mix_id", "mix_source", "mix_size").orderBy("mix_copies")))
        sized = sized.withColumn("nth", F.row_number().over(Window.partitionBy(at_id, at_source, "words").orderBy(at_text)))
        same = sized[at_id].eqNullSafe(plan["mix_id"]) & sized[at_source].eqNullSafe(plan["mix_source"]) & (sized["words"] == plan["mix_size"]) & (sized["nth"] == plan["mix_nth"])
    # Rows move once at every size: whether the plan is small enough to send along is not left to its table's.
    taken = sized.hint("merge").join(plan.where("mix_copies > 0"), same)
    kept = [(i, c) for i, c in enumerate(docs.columns) if c.lower() != "copy"]
    rows = taken.select(*(f"c{i}" for i, _ in kept), F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy"))
    return rows.toDF(*(c for _, c in kept), "copy")
