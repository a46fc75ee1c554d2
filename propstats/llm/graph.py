"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of ``edges`` (a, b, both long): root is the component's least node.

    A round joins each node's larger neighbours, then its smaller ones, to the least node it sees. Stars
    remain when nothing changes, after a number of rounds that grows with the logarithm of a component's size.
    Every round is a stored table, so a lost executor costs one round. Least nodes are found by
    pre-aggregation; hubs are then joined on, which adaptive execution splits.
    """
    stars = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if seen == state or seen[0] == 0:
            break
        state = seen
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a")
        large = large.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = large.join(_least(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b")))
        stars = stored(small.distinct(), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
