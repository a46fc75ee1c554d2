"""Price statistics per group, exact and safe against hot groups.

The rows are first counted per (group, price) with map-side combining. A group of any size thus
shrinks to its distinct prices before it is brought together, so neither the shuffle nor the task
that ranks the prices grows with the number of sales in the hottest group; prices are whole
pounds in an INT column, which bounds the histogram. Percentiles are then discrete order
statistics read off the running count, and the moments are weighted sums around the group mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions import postcode as pc
from propstats.operators.geography import with_geography, with_year
from propstats.schema import COMMON_KEYS, LEVELS, PERCENTILE_COLUMNS, ZONE, level_keys


def price_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per (keys, price), as column ``n``."""
    return df.groupBy(*keys, "price").agg(F.count(F.lit(1)).alias("n"))


def histogram_statistics(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, moments and percentiles from a histogram; rows may repeat a price within a group."""
    by_price = Window.partitionBy(*keys).orderBy("price")
    so_far = by_price.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_price.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    priced = F.when(F.col("price").isNotNull(), F.col("n")).otherwise(F.lit(0))
    weighed = histogram.withColumn("_priced", priced).withColumn(
        "_value", F.col("_priced").cast("double") * F.col("price")
    )
    # One window specification, so one sort and one pass over the group.
    ranked = weighed.select(
        *keys,
        "price",
        "n",
        "_priced",
        F.sum("_priced").over(so_far).alias("_below"),
        F.sum("_priced").over(whole).alias("_total"),
        F.sum("_value").over(whole).alias("_sum"),
    )
    centred = ranked.withColumn("_mean", F.try_divide(F.col("_sum"), F.col("_total"))).withColumn(
        "_off", F.col("price") - F.col("_mean")
    )

    def moment(order: int) -> Column:
        power = F.col("_off")
        for _ in range(order - 1):
            power = power * F.col("_off")
        return F.sum(F.col("_priced") * power)

    # The smallest price at or below which a share p of the priced rows lies, in whole numbers.
    quantiles = [
        F.min(
            F.when(
                (F.col("_priced") > 0) & (F.col("_below") * 100 >= F.col("_total") * round(p * 100)),
                F.col("price"),
            )
        ).alias(name)
        for p, name in PERCENTILE_COLUMNS.items()
    ]
    grouped = centred.groupBy(*keys).agg(
        F.sum("n").alias("num_transactions"),
        F.max("_mean").alias("_avg"),
        F.max("_total").cast("double").alias("_n"),
        moment(2).alias("_m2"),
        moment(3).alias("_m3"),
        moment(4).alias("_m4"),
        *quantiles,
    )
    spread = F.col("_m2") > 0
    return grouped.select(
        *keys,
        "num_transactions",
        F.round("_avg", 1).alias("avg_price"),
        F.round(F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1))), 1).alias("stddev_price"),
        *PERCENTILE_COLUMNS.values(),
        F.round(
            F.when(spread, F.sqrt("_n") * F.col("_m3") / F.sqrt(F.col("_m2") * F.col("_m2") * F.col("_m2"))), 2
        ).alias("skewness_price"),
        F.round(F.when(spread, F.col("_n") * F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3), 2).alias(
            "kurtosis_price"
        ),
    )


def with_dispersion(stats: DataFrame) -> DataFrame:
    """Add the dispersion metrics; they are computed from the already rounded statistics."""
    iqr = F.col("75th_percentile_price") - F.col("25th_percentile_price")
    median = F.col("median_price")
    return (
        stats.withColumn("coef_var", F.round(F.try_divide(F.col("stddev_price"), F.col("avg_price")) * 100, 1))
        .withColumn("iqr", iqr)
        .withColumn("median_mean_diff", F.round(median - F.col("avg_price"), 1))
        .withColumn(
            "median_mean_diff_pct", F.round(F.abs(F.try_divide(F.col("median_mean_diff"), median)) * 100, 1)
        )
        .withColumn("iqr_pct", F.round(F.try_divide(F.col("iqr").cast("double"), median) * 100, 1))
    )


def price_statistics(df: DataFrame, keys: Sequence[str] | str, accuracy: int | None = None) -> DataFrame:
    """Price statistics of ``df`` per group of ``keys``, with the dispersion metrics.

    Exact by default. With ``accuracy`` the five percentiles come from one approximate sketch per
    group instead: one shuffle fewer, and an error in rank of at most ``rows / accuracy``. The
    sketches of a group merge in one task, so keep that for data without very hot groups.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if accuracy is None:
        return with_dispersion(histogram_statistics(price_histogram(df, keys), keys))
    sketch = F.percentile_approx("price", list(PERCENTILE_COLUMNS), accuracy)
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_transactions"),
        F.round(F.avg("price"), 1).alias("avg_price"),
        F.round(F.stddev("price"), 1).alias("stddev_price"),
        sketch.alias("_sketch"),
        F.round(F.skewness("price"), 2).alias("skewness_price"),
        F.round(F.kurtosis("price"), 2).alias("kurtosis_price"),
    )
    return with_dispersion(
        grouped.select(
            *keys,
            "num_transactions",
            "avg_price",
            "stddev_price",
            *[F.col("_sketch")[i].alias(name) for i, name in enumerate(PERCENTILE_COLUMNS.values())],
            "skewness_price",
            "kurtosis_price",
        )
    )


def sales_histogram(sales: DataFrame, level: str = "sector", mode: str = "all_letters") -> DataFrame:
    """One scan of the sales, counted per price at a geographic level; columns as ``level_keys`` plus price and ``n``.

    Area and zone follow from the district. From the district level down they are left out of the
    shuffled key and worked out once per histogram row instead of once per sale.
    """
    if level == "area":
        return price_histogram(with_geography(sales, mode), level_keys(level))
    placed = with_year(pc.with_district_and_sector(sales.na.drop(subset=["postcode"])))
    codes = [code for code in LEVELS[level] if code != "postcode_area"]
    fine = price_histogram(placed, [*codes, "property_type", "year"])
    return fine.withColumn("postcode_area", pc.area_from_district("postcode_district", mode)).withColumn(
        ZONE, pc.london_zone()
    )


def level_statistics(sales: DataFrame, level: str, mode: str = "all_letters") -> DataFrame:
    """Statistics of one geographic level."""
    return with_dispersion(histogram_statistics(sales_histogram(sales, level, mode), level_keys(level)))


def multi_level_statistics(sales: DataFrame, mode: str = "all_letters") -> DataFrame:
    """Area, district and sector statistics from one scan, with a ``level`` column; codes below a level are null.

    Each coarser histogram is summed from the finer one, and each level's statistics come from its own
    histogram: the finest one, which hardly shrinks, is not copied for the others.
    """
    histograms = {"sector": sales_histogram(sales, "sector", mode)}
    for level, finer in (("district", "sector"), ("area", "district")):
        histograms[level] = histograms[finer].groupBy(*level_keys(level), "price").agg(F.sum("n").alias("n"))
    parts = []
    for level in LEVELS:
        stats = histogram_statistics(histograms[level], level_keys(level)).withColumn("level", F.lit(level))
        below = {c: F.lit(None).cast("string") for c in LEVELS["sector"] if c not in LEVELS[level]}
        parts.append(stats.withColumns(below) if below else stats)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    first = ["level", *LEVELS["sector"], *COMMON_KEYS]
    return with_dispersion(union.select(*first, *[c for c in union.columns if c not in first]))
