"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node, those above it (large) or below it, to the least of the neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, root): for every node that has an edge, the least node that it is connected with.

    edges: integer columns a and b. Null ends and loops are ignored; repeated edges count once; no edge gives no row.
    Each round is written, so that the plan stays short and a lost executor costs one round.
    """
    now = work.store(edges.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        k += 1
        next_ = work.store(_star(_star(now, large=True), large=False), f"{name}-{k}")
        state = next_.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        now = next_
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()).toDF("node", "root")
