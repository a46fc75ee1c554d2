"""Sampling. A seedless, repeatable sample by hash, and Spark's own random sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key hashes into the lowest share of the hash range: the same rows on every run."""
    bound = format(min(round(fraction * 16**8), 16**8 - 1), "08x")
    return df.where(F.substring(F.md5(F.col(key)), 1, 8) < bound)


def class_samples(df: DataFrame, label: str, key: str, fraction: float = 0.01, cap: int = 100) -> DataFrame:
    """A sample of every class, at most ``cap`` rows each (the lowest hashes).

    Rows are ranked within one of 256 hash buckets of their class first, so a hot class spreads over that
    many groups whatever the cap; only the best ``cap`` of each bucket meet in the second ranking.
    """
    order = [F.md5(F.col(key)), F.col(key)]
    # The last digits: the sample itself is cut by the first ones.
    sampled = hash_sample(df, key, fraction).withColumn("_bucket", F.substring(F.md5(F.col(key)), 31, 2))
    for keys in ([label, "_bucket"], [label]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        sampled = sampled.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return sampled.drop("_rank", "_bucket")


def random_sample(df: DataFrame, fraction: float, cap: int, seed: int | None = None) -> DataFrame:
    """A random share of the rows without replacement, cut off at ``cap``."""
    return df.sample(False, fraction, seed).limit(cap)
