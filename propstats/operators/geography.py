"""Give every sale its place in the postcode hierarchy and its year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.functions import postcode as pc
from propstats.schema import ZONE


def with_year(df: DataFrame) -> DataFrame:
    """Add ``year`` from the transfer date.

    A table that already carries ``year`` keeps it: it is the partition column there, and
    recomputing it would stop partition pruning.
    """
    return df if "year" in df.columns else df.withColumn("year", F.year("date_transfer"))


def counts_by_place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales counted per ``keys`` (of the columns that ``with_geography`` adds, and the sales' own).

    Sales are counted per raw postcode first: there are far fewer postcodes than sales, and each is parsed once.
    """
    own = [k for k in keys if k in df.columns and k != "year"]
    raw = with_year(df.na.drop(subset=["postcode"])).groupBy("postcode", *own, "year").agg(F.count(F.lit(1)).alias("_n"))
    return with_geography(raw).groupBy(*keys).agg(F.sum("_n").alias("num_transactions"))


def with_geography(df: DataFrame, mode: str = "all_letters") -> DataFrame:
    """Drop sales without a postcode; add the postcode parts, the London zone and the year."""
    placed = pc.with_postcode_parts(df.na.drop(subset=["postcode"]), mode=mode)
    return with_year(placed.withColumn(ZONE, pc.london_zone()))
