"""Sample-quality flags, pass rates and the low-volume filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions.labels import round_half_up

# Default thresholds, and the ones the gold tables are built with.
DEFAULT_THRESHOLDS = {
    "min_transactions": 30,
    "max_coef_var": 50,
    "max_median_mean_diff_pct": 30,
    "max_iqr_pct": 25,
}
GOLD_THRESHOLDS = {
    "min_transactions": 30,
    "max_coef_var": 50,
    "max_median_mean_diff_pct": 10,
    "max_iqr_pct": 25,
}


def with_quality_flag(df: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``is_good_sample``: enough sales, low variation, little skew. Missing thresholds use the defaults."""
    limits = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    return df.withColumn(
        "is_good_sample",
        (F.col("num_transactions") >= limits["min_transactions"])
        & (F.col("coef_var") <= limits["max_coef_var"])
        & (F.col("median_mean_diff_pct") <= limits["max_median_mean_diff_pct"])
        & (F.col("iqr_pct") <= limits["max_iqr_pct"]),
    )


def pass_rate(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples, good samples and the share of good ones, in one pass."""
    good = F.count_if("is_good_sample")
    total = F.count(F.lit(1))
    return flagged.groupBy(*by).agg(
        good.alias("good_samples"),
        total.alias("total_samples"),
        round_half_up(F.try_divide(good * 100, total)).alias("pass_rate_pct"),
    )


def drop_low_volume(
    stats: DataFrame, threshold: int, since_year: int, key: str = "postcode_district"
) -> DataFrame:
    """Drop every row of a key that has, in any year from ``since_year`` on, ``threshold`` sales or fewer.

    One window pass over the aggregate instead of an anti-join with itself, which would compute
    the aggregate twice. A key holds one row per type and year. A null key is kept, as no list of
    breaching keys can name it.
    """
    breach = (F.col("num_transactions") <= threshold) & (F.col("year") >= since_year)
    ever = F.max(F.coalesce(breach, F.lit(False))).over(Window.partitionBy(key))
    return stats.withColumn("_breach", ever).where(~F.col("_breach") | F.col(key).isNull()).drop("_breach")
