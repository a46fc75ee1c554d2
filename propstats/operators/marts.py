"""Join the gold trends with the district indicators and cut the result into marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions import names
from propstats.functions.labels import property_type_name
from propstats.functions.postcode import LONDON_ZONES, UNKNOWN
from propstats.operators.ranking import with_position
from propstats.schema import DISPERSION_COLUMNS, INDICATORS, STATISTIC_COLUMNS, TREND_COLUMNS, ZONE

# Columns of the geometry mart and of the series mart.
GEOMETRY_COLUMNS = [
    "PostDist", "geometry", "srid", "AreaName", "CountLowLevelAreas", "AreaKm2",
    "TotalPopulation", "DependentChildren", "Population60Plus", "WorkingAgePopulation",
    "DependentChildren%", "Population60Plus%", "WorkingAgePopulation%", "PopulationDensity",
    *[f"{name}{kind}" for name in INDICATORS for kind in ("Avg", "RankAvg")],
]
SERIES_COLUMNS = [
    "postcode_area", "postcode_district", "PostDist", ZONE, "property_type", "year",
    *STATISTIC_COLUMNS, *DISPERSION_COLUMNS, *TREND_COLUMNS, "is_good_sample",
]
# Columns of the price chart, and those that later tables leave out.
PRICE_GRAPH_COLUMNS = ["postcode_district", "year", "avg_price", "median_price", "num_transactions"]
SPREAD_COLUMNS = [f"{name}{kind}" for name in INDICATORS for kind in ("Median", "Min", "Max")]
UNUSED_COLUMNS = [
    *DISPERSION_COLUMNS, "lag_median_price", "median_pct_change_1_year", "roll_median_pct_2_year", "is_good_sample",
]
LATEST_METRIC = "5YearAvg%PriceInc"


def trends_with_socio(trends: DataFrame, socio: DataFrame) -> DataFrame:
    """District trends with the indicators of their district; trends without a polygon drop out.

    Both sides are aggregates. No side is forced into a broadcast: adaptive execution does that
    when it has seen how large they are.
    """
    joined = trends.join(socio, F.col("postcode_district") == F.col("PostDist"), "left")
    return joined.where(F.col("PostDist").isNotNull() & (F.col("PostDist") != UNKNOWN))


def in_london(df: DataFrame, property_type: str | None = None) -> DataFrame:
    """Rows of the London zones, of one property type if given."""
    kept = df.where(F.col(ZONE).isin(LONDON_ZONES))
    return kept if property_type is None else kept.where(F.col("property_type") == property_type)


def rows_with_key_in(df: DataFrame, other: DataFrame, key: str = "PostDist") -> DataFrame:
    """Rows whose key occurs in the other table; its keys are made distinct before they travel."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def geometry_mart(socio: DataFrame, series: DataFrame) -> DataFrame:
    """One row per district of the series: polygon and static indicators.

    Taken from the district table, not from the joined series, so no polygon is copied per year.
    """
    return rows_with_key_in(socio, series).select(*names.available(socio, GEOMETRY_COLUMNS))


def series_mart(series: DataFrame) -> DataFrame:
    """The yearly facts without polygons and static columns."""
    return series.select(*names.available(series, SERIES_COLUMNS))


def rejoin(series: DataFrame, geometry: DataFrame) -> DataFrame:
    """Put the two marts back together under their display names."""
    return names.with_pascal_names(series).join(names.with_pascal_names(geometry), "PostDist", "left")


def first_values(df: DataFrame, key: str, order: str | Column, columns: Sequence[str]) -> DataFrame:
    """Per key, each column's first value that is not null, in a fixed order."""
    order = F.col(order) if isinstance(order, str) else order
    firsts = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns
    ]
    return df.groupBy(key).agg(*firsts)


def price_graph(df: DataFrame) -> DataFrame:
    """Distinct rows of the columns a price chart needs; columns the table lacks are left out."""
    return df.select(*names.available(df, PRICE_GRAPH_COLUMNS)).distinct()


def type_counts(stats: DataFrame, year: int | None = None) -> DataFrame:
    """Sales per district and property type name, of one year or of all; unmapped types drop out."""
    rows = stats if year is None else stats.where(F.col("year") == year)
    return (
        rows.select("postcode_district", property_type_name().alias("property_type"), "num_transactions")
        .where(F.col("postcode_district").isNotNull() & F.col("property_type").isNotNull())
        .groupBy("postcode_district", "property_type")
        .agg(F.sum("num_transactions").alias("num_transactions"))
    )


def with_latest_metric(
    df: DataFrame,
    year: int,
    metric: str = "roll_median_pct_5_year",
    name: str = LATEST_METRIC,
    keys: Sequence[str] = ("postcode_district", "property_type"),
) -> DataFrame:
    """Attach the metric of one year to every row of its keys; keys without that year drop out.

    One window pass over the aggregate stands for the self-join, which would compute it twice. A
    key holds one row per year.
    """
    series = Window.partitionBy(*keys)
    latest = F.col("year") == year
    return (
        df.withColumn("_has_latest", F.max(F.coalesce(latest, F.lit(False))).over(series))
        .withColumn(name, F.max(F.when(latest, F.col(metric))).over(series))
        .where("_has_latest")
        .drop("_has_latest")
    )


def hotspots(df: DataFrame, year: int) -> DataFrame:
    """Rows with their position by the latest five-year growth, then district, type, and year backwards."""
    order = [F.desc_nulls_last(LATEST_METRIC), "postcode_district", "property_type", F.desc("year")]
    ranked = with_position(with_latest_metric(df, year).drop(*UNUSED_COLUMNS), *order)
    return ranked.orderBy("position")
