"""Connected components by alternating large-star and small-star rounds, in joins, aggregations and windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.shared import drop_written, written

#: Rounds grow with the square of the logarithm of a component at most; beyond these something else is wrong.
ROUNDS = 60


def _round(edges: DataFrame) -> DataFrame:
    """edges (a > b). Each node's larger neighbours are hung on its smallest neighbour, then its smaller ones.

    A node may have any number of larger neighbours: their minimum is pre-aggregated, and the join on the node can be split. Smaller
    neighbours are few, as each is the smallest neighbour of a neighbour.
    """
    both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    large = both.join(least, "a").where("b > a").selectExpr("b as a", "_m as b")
    w = Window.partitionBy("a").orderBy("b")
    seen = large.withColumn("_m", F.first("b").over(w)).withColumn("_before", F.lag("b").over(w)).where("_before is null or _before <> b")
    return seen.select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches. Nodes that are their own smallest are left out.

    Each round's edges are a table in the shared folder; rounds end when one changes nothing. Raises RuntimeError if ROUNDS do not suffice.
    """
    now, state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    old = None
    for _ in range(ROUNDS):
        after = written(_round(now), "edges")
        r = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if old is not None:
            drop_written(old)
        now = old = after
        if (r.n, r.s) == state or not r.n:
            return now.selectExpr("a as node", "b as component").distinct()
        state = (r.n, r.s)
    raise RuntimeError(f"components did not converge in {ROUNDS} rounds")
