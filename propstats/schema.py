"""Table schemas and column lists shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# The sixteen fields of a raw sale record, in file order.
SALE_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("price", T.IntegerType()),
        T.StructField("date_transfer", T.DateType()),
        T.StructField("postcode", T.StringType()),
        T.StructField("property_type", T.StringType()),
        T.StructField("old_new", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("paon", T.StringType()),
        T.StructField("saon", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("locality", T.StringType()),
        T.StructField("town_city", T.StringType()),
        T.StructField("district", T.StringType()),
        T.StructField("county", T.StringType()),
        T.StructField("ppd_category", T.StringType()),
        T.StructField("record_status", T.StringType()),
    ]
)

# Columns every quality report looks at.
CRITICAL_COLUMNS = ["price", "date_transfer", "postcode", "property_type"]

ZONE = "is_london?"

# Output columns of the price statistics, then of the trends.
PERCENTILE_COLUMNS = {
    0.25: "25th_percentile_price",
    0.5: "median_price",
    0.75: "75th_percentile_price",
    0.9: "90th_percentile_price",
    0.95: "95th_percentile_price",
}
STATISTIC_COLUMNS = [
    "num_transactions",
    "avg_price",
    "stddev_price",
    *PERCENTILE_COLUMNS.values(),
    "skewness_price",
    "kurtosis_price",
]
DISPERSION_COLUMNS = ["coef_var", "iqr", "median_mean_diff", "median_mean_diff_pct", "iqr_pct"]
TREND_COLUMNS = [
    "lag_median_price",
    "median_pct_change_1_year",
    "roll_median_pct_2_year",
    "roll_median_pct_5_year",
]

# Geographic levels, broadest first: the postcode keys each one groups by.
LEVELS = {
    "area": ["postcode_area"],
    "district": ["postcode_area", "postcode_district"],
    "sector": ["postcode_area", "postcode_district", "postcode_sector"],
}
COMMON_KEYS = [ZONE, "property_type", "year"]


def level_keys(level: str) -> list[str]:
    return LEVELS[level] + COMMON_KEYS


# The eight indicators rolled up to districts.
INDICATORS = [
    "Overall",
    "Income",
    "Employment",
    "Education",
    "Health",
    "Crime",
    "HousingBarriers",
    "Environment",
]
POPULATION_COLUMNS = ["TotalPopulation", "DependentChildren", "Population60Plus", "WorkingAgePopulation"]

# Geometry: polygon parts -> rings (outer first) -> points. A simple polygon has one part.
POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING_TYPE = T.ArrayType(POINT_TYPE)
PART_TYPE = T.ArrayType(RING_TYPE)
GEOMETRY_TYPE = T.ArrayType(PART_TYPE)
