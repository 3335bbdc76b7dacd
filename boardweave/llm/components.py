"""Groups out of pairwise matches: deterministic Borůvka hooking with pointer doubling.

Every component selects its smallest outgoing edge; the selected edges form trees, whose roots are found
by pointer doubling; edges are relabelled by root and deduplicated until none remain. A round at least
halves the components that still have edges, so there are at most log2(vertices) rounds, each a fixed
number of hash joins. The driver sees only counts.

Vertices get ids in the order of their values (range sort, then row number inside each range), so edges
are 16 bytes wide and the smallest id of a group is its smallest value. Each round's tables are written
to the shared folder: lineage is cut and lost executors cost a re-read, not a re-run.

Defined results: a pair with a null end, or with both ends equal, joins nothing; repeated and reversed
pairs count once; an empty table gives an empty result; '' is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.llm.common import dropped, partitions, written


def numbered(values: DataFrame, col: str) -> DataFrame:
    """value, id: the different values of ``col`` with ids in the order of the values (code points)."""
    spark = values.sparkSession
    v = values.select(F.col(col).alias("value")).where("value is not null").distinct()
    v = v.repartitionByRange(partitions(spark), "value").sortWithinPartitions("value")
    return written(v.withColumn("id", F.monotonically_increasing_id()))


def _hooks(edges: DataFrame) -> DataFrame:
    """c, p: each component and the other end of its smallest outgoing edge; of a mutual choice the smaller is root.

    The smallest edge is by (smaller end, larger end), a total order, so choices form no longer cycle.
    """
    e = F.struct(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    both = edges.select(F.col("u").alias("c"), e.alias("e")).union(edges.select(F.col("v").alias("c"), e.alias("e")))
    best = both.groupBy("c").agg(F.min("e").alias("e"))
    p = F.when(F.col("c") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo"))
    return best.select("c", p.alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """id, root over all ends of ``edges`` (u, v: bigint); root is the smallest id of the component."""
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = written(e)
    labels = None  # id, root: every vertex so far and the component that holds it
    while e.limit(1).count():
        hooks = written(_hooks(e))
        a, b = hooks.alias("a"), hooks.alias("b")
        # of two components that chose each other the smaller becomes the root
        t = a.join(b, F.col("a.p") == F.col("b.c")).select(
            F.col("a.c").alias("c"),
            F.when((F.col("b.p") == F.col("a.c")) & (F.col("a.c") < F.col("a.p")), F.col("a.c")).otherwise(F.col("a.p")).alias("p"),
        )
        tree = written(t)
        dropped(hooks)
        while True:
            a, b = tree.alias("a"), tree.alias("b")
            up = a.join(b, F.col("a.p") == F.col("b.c")).select(F.col("a.c").alias("c"), F.col("b.p").alias("p"), (F.col("a.p") != F.col("b.p")).alias("moved"))
            up = written(up)
            moved = up.where("moved").limit(1).count()
            dropped(tree)
            tree = up
            if not moved:
                break
        tree_ends = tree.select("c", "p")
        x, y = tree_ends.toDF("u", "ru"), tree_ends.toDF("v", "rv")
        nxt = e.join(x, "u").join(y, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        nxt = written(nxt)
        dropped(e)
        e = nxt
        new = tree_ends.toDF("id", "root")
        if labels is not None:
            # vertices labelled before move with their component; components without edges stay
            old = labels.alias("l").join(new.alias("n"), F.col("l.root") == F.col("n.id"), "left")
            new = old.select(F.col("l.id").alias("id"), F.coalesce("n.root", "l.root").alias("root"))
        labels, last = written(new), labels
        if last is not None:
            dropped(last)
        dropped(tree)
    if labels is None:
        return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    # a root need not be the smallest id of its component
    least = labels.groupBy("root").agg(F.min("id").alias("least"))
    return labels.join(least, "root").select("id", F.col("least").alias("root"))


def linked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """value, group: each value that is joined with another, and the smallest value of its group."""
    p = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    p = written(p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = numbered(p.select(F.explode(F.array("a", "b")).alias("value")), "value")
    x, y = ids.select(F.col("value").alias("a"), F.col("id").alias("u")), ids.select(F.col("value").alias("b"), F.col("id").alias("v"))
    found = components(p.join(x, "a").join(y, "b").select("u", "v"))
    group = ids.select(F.col("value").alias("group"), F.col("id").alias("root"))
    return found.join(ids, "id").join(group, "root").select("value", "group")
