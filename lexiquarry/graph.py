"""Connected components over edge tables, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.session import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``edges``; ``root`` is the smallest node reachable.

    Alternating large-star and small-star rounds: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, so paths shrink geometrically. Minima combine before the shuffle and the joins are plain
    equi-joins, which adaptive execution splits, so a node with very many neighbours never meets in one task.
    Null ends and self loops are dropped; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not e.limit(1).count():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        mid = large.join(low, large.a == low.k)
        star = mid.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        step = materialise(star.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        discard(large)
        e = step
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
