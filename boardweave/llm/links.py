"""Links joined by verdicts and by group membership, as edges for the component operator."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_edges(pairs: DataFrame) -> DataFrame:
    """a, b: the two links of each positive verdict; other verdicts, null links and self-pairs give none."""
    p = pairs.where("duplicate").select(F.get("urls", F.lit(0)).alias("a"), F.get("urls", F.lit(1)).alias("b"))
    return p.where("a <> b")


def member_edges(groups: DataFrame) -> DataFrame:
    """a, b: each member link of a row with that row's first link. A chain of edges, not all pairs, joins a row."""
    links = F.array_distinct(F.filter(F.transform("members", lambda m: m["文章链接"]), lambda x: x.isNotNull()))
    g = groups.select(links.alias("l")).where(F.size("l") > 1)
    return g.select(F.get("l", F.lit(0)).alias("a"), F.explode(F.slice("l", 2, F.size("l") - 1)).alias("b"))
