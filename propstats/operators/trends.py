"""Year-on-year and rolling price changes per yearly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propstats.schema import TREND_COLUMNS


def price_trends(stats: DataFrame, series_keys: Sequence[str]) -> DataFrame:
    """Add the previous median, the yearly change and its 2 and 5 row means; then zero-fill numbers.

    ``series_keys`` identify a yearly series; ``year`` is dropped from them if given. Frames count
    rows, so "previous year" is the previous year present. Rolling means use the unrounded change.
    Every null number becomes 0, whichever column it is in. A series holds one row per year.
    """
    series = Window.partitionBy(*[k for k in series_keys if k != "year"]).orderBy("year")
    median, previous = F.col("median_price").cast("double"), F.col("lag_median_price").cast("double")
    changed = stats.withColumn("lag_median_price", F.lag("median_price", 1).over(series)).withColumn(
        "_change", F.try_divide((median - previous) * 100, previous)
    )
    one_year, two_years, five_years = TREND_COLUMNS[1:]
    return (
        changed.withColumn(one_year, F.round("_change", 1))
        .withColumn(two_years, F.round(F.avg("_change").over(series.rowsBetween(-1, 0)), 1))
        .withColumn(five_years, F.round(F.avg("_change").over(series.rowsBetween(-4, 0)), 1))
        .drop("_change")
        .fillna(0)
    )
