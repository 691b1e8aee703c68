"""Connected components of edges that stay in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, spread_join, written


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest reachable id) for every id on an edge (columns a and b).

    Alternates large-star and small-star steps until the edges are stars: each step joins the edges with the smallest
    neighbour of each id, so the number of rows never exceeds twice that of the edges, and written tables cut the lineage.
    The neighbours are broadcast while their ids, two an edge at most, are few enough; beyond that only those of ids with
    a large share of the edges are, so that the edges of one id stay spread over tasks."""

    def hung(rows: DataFrame, n: int) -> DataFrame:
        """rows, at most n, with m: the smallest of a and its neighbours."""
        least = rows.groupBy("a").agg(F.min("b").alias("_b"), F.count("*").alias("_n"))
        least = least.select("a", F.least("a", "_b").alias("m"), "_n")
        joined = rows.join(F.broadcast(least), "a") if n <= MAX_BROADCAST_ROWS else spread_join(rows, least, "a", "_n", n)
        return joined.select("a", "b", "m")

    def measured(rows: DataFrame) -> tuple[int, bool]:
        """Number of the rows (a above b), and whether they are stars: no id has two rows, or one and another id below it."""
        ends = rows.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(rows.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, tangled = ends.agg(F.sum("up"), F.max(F.expr("up + down > 1 and up > 0"))).first()
        return n or 0, not tangled

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    n, done = measured(now)
    while not done:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = hung(both, 2 * n).filter("b > a")  # every larger neighbour hangs on the smallest one
        down = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = hung(down, n)
        both = small.select(F.inline(F.array(*[F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("a", "b")])))
        now = written(both.filter("a <> b").distinct())
        n, done = measured(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
