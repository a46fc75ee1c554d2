"""Price quantiles from mergeable sketches: kept per sector and year, merged into any coarser group and any years.

The sales are read once, for the finest level. A sketch holds a few thousand bytes whatever its group's size, and two
merge into what the sales of both would have made, so districts, areas and spans of years come from the stored
sketches alone. Quantiles are off by a share of ranks that shrinks as ``k`` grows, not with the number of merges; groups of
fewer sales than ``k`` are exact.

Null prices are counted as transactions and are in no sketch; a group without a price has null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.operators.geography import with_geography
from propstats.schema import LEVELS, PERCENTILE_COLUMNS, ZONE

K = 800
#: Share of ranks that a quantile at ``K`` may be off; about three times what 99 of 100 quantiles stay within.
RANK_ERROR = 0.01
_MEASURES = ["num_transactions", "num_priced", "price_sketch"]


def price_sketches(sales: DataFrame, keys: Sequence[str] | None = None, k: int = K, mode: str = "all_letters") -> DataFrame:
    """One row per group of ``keys`` (the sector, its coarser codes, property type and year by default)."""
    rows = with_geography(sales, mode) if keys is None else sales
    keys = [*LEVELS["sector"], ZONE, "property_type", "year"] if keys is None else list(keys)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_transactions"),
        F.count("price").alias("num_priced"),
        F.kll_sketch_agg_bigint(F.col("price").cast("long"), F.lit(k)).alias("price_sketch"),
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups; each task merges what it has of a group before anything is shuffled."""
    full = F.when(F.col("num_priced") > 0, F.col("price_sketch"))
    return sketches.groupBy(*keys).agg(
        F.sum("num_transactions").alias("num_transactions"), F.sum("num_priced").alias("num_priced"), F.kll_merge_agg_bigint(full).alias("price_sketch")
    )


def quantiles(sketches: DataFrame) -> DataFrame:
    """The percentile columns of each group in place of its sketch."""
    found = F.when(F.col("num_priced") > 0, F.kll_sketch_get_quantile_bigint("price_sketch", F.array(*[F.lit(p) for p in PERCENTILE_COLUMNS])))
    others = [c for c in sketches.columns if c != "price_sketch"]
    named = [F.get("_found", F.lit(i)).alias(name) for i, name in enumerate(PERCENTILE_COLUMNS.values())]
    return sketches.withColumn("_found", found).select(*others, *named)


def rank_errors(found: DataFrame, sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, percentile, value, error): how far, as a share of ranks, each quantile is off in ``sales``.

    A value stands for all ranks from the sales below it to those not above it; the error is the distance of
    the percentile from that range. Sales are counted per price before they meet the quantiles.
    """
    entries = ", ".join(f"{p}D, `{name}`" for p, name in PERCENTILE_COLUMNS.items())
    asked = found.select(*keys, F.expr(f"stack({len(PERCENTILE_COLUMNS)}, {entries}) AS (percentile, value)")).where("value IS NOT NULL")
    counted = sales.where("price IS NOT NULL").groupBy(*keys, "price").agg(F.count(F.lit(1)).alias("n"))
    ranks = counted.join(asked, list(keys)).groupBy(*keys, "percentile", "value").agg(
        F.sum(F.when(F.col("price") < F.col("value"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("price") <= F.col("value"), F.col("n")).otherwise(0)).alias("upto"),
        F.sum("n").alias("all"),
    )
    error = F.greatest(F.col("below") / F.col("all") - F.col("percentile"), F.col("percentile") - F.col("upto") / F.col("all"), F.lit(0.0))
    return ranks.select(*keys, "percentile", "value", error.alias("error"))
