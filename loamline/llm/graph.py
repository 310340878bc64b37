"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) of each node that has an edge; component is the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step points a node's
    neighbours at the smallest of them, so stars shrink on both ends and a chain of n links takes about
    log n rounds. The smallest neighbour is a partial aggregate, so a node that a third of all edges
    share costs a row a task, and the join back to its edges is one that Spark can split. Each round is
    kept in the checkpoint folder until the next one is. Edges with a null end and loops are ignored; repeated edges count
    once; an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Large-star: every larger neighbour of a node points at the smallest node around it.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
        large = both.join(low, both["a"] == low["hub"]).where(F.col("b") > F.col("hub")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), "low")
        small = large.join(least, large["a"] == least["hub"]).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
        after = cut(small.where("a <> b").distinct())
        new = _state(after)
        drop(now)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    rows = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rows.unionByName(rows.select(F.col("component").alias("node"), "component").distinct())
    out._cut_at = now._cut_at
    return out
