"""Connected components by alternating large and small stars, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm._common import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` → ``(v, root)`` for each vertex that is not the smallest of its component.

    Each round hangs larger neighbours on the smallest one, then joins what hangs there; rounds grow with the
    logarithm of the longest path. Edges stay in tables; the driver sees only whether all hangs on roots.
    """
    star = ws.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        done = ws.table(small)
        ws.drop(star)
        star = done
        # done when the edges are stars: no vertex with two edges up, or with one up and one down
        ends = star.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(star.select("b", F.lit(0), F.lit(1)))
        if ws.is_empty(ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0")):
            return star.select(F.col("a").alias("v"), F.col("b").alias("root"))
