"""Connected groups of articles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.operators.scratch import dropped, written


def _sum(edges: DataFrame) -> tuple:
    """Count and two order-free hash sums of all edges, in one pass without a shuffle of edges."""
    h = [F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *h).first())


def connected(edges: DataFrame) -> DataFrame:
    """value, root over both ends of edges(a, b): the smallest value reachable from each.

    Alternating large-star and small-star contraction: every vertex hands its smallest neighbour to its larger,
    then to its smaller ones, which takes a logarithmic number of rounds and never more edges than there were.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _sum(e)
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("p")).select(F.col("p.x").alias("a"), F.col("p.m").alias("b")).where("a <> b").distinct()
        nxt = written(small)
        now = _sum(nxt)
        dropped(e)
        e = nxt
        if now == was:  # two rounds with the same count and the same two hash sums hold the same edges
            break
        was = now
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("value"), F.col("b").alias("root")).union(roots.select(F.col("b").alias("value"), F.col("b").alias("root")))
