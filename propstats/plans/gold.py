"""Sales to gold tables: statistics, trends and quality flags per geographic level."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from propstats.operators.price_stats import level_statistics, multi_level_statistics
from propstats.operators.quality import GOLD_THRESHOLDS, with_quality_flag
from propstats.operators.trends import price_trends
from propstats.schema import LEVELS, ZONE

# The keys of one yearly series. All sales without an inward code share the sector Unknown, so a
# sector series is told apart by its district as well.
SERIES_KEYS = {
    "area": ["postcode_area", ZONE, "property_type"],
    "district": ["postcode_district", ZONE, "property_type"],
    "sector": ["postcode_district", "postcode_sector", ZONE, "property_type"],
}


def level_trends(
    sales: DataFrame,
    level: str,
    thresholds: Mapping[str, float] = GOLD_THRESHOLDS,
    mode: str = "all_letters",
) -> DataFrame:
    """The gold table of one level, from the sales in one lazy plan."""
    return with_quality_flag(price_trends(level_statistics(sales, level, mode), SERIES_KEYS[level]), thresholds)


def all_level_trends(
    sales: DataFrame, thresholds: Mapping[str, float] = GOLD_THRESHOLDS, mode: str = "all_letters"
) -> DataFrame:
    """The gold tables of all levels from one scan, told apart by ``level``."""
    stats = multi_level_statistics(sales, mode)
    series = ["level", *LEVELS["sector"], ZONE, "property_type"]
    return with_quality_flag(price_trends(stats, series), thresholds)
