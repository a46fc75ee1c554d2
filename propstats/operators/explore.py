"""The data side of the dashboards: parameterised selections on the marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions import names
from propstats.functions.labels import year_start
from propstats.operators.quality import drop_low_volume
from propstats.schema import ZONE
from propstats.sources.tables import stored


def select_zone_districts(df: DataFrame, zones: Sequence[str], threshold: int, since_year: int) -> DataFrame:
    """Rows of districts in the chosen zones, without the low-volume districts."""
    return drop_low_volume(df, threshold, since_year).where(F.col(ZONE).isin(list(zones)))


def in_districts(df: DataFrame, districts: Sequence[str], key: str = "PostDist") -> DataFrame:
    return df.where(F.col(key).isin(list(districts)))


def comparison_table(df: DataFrame, year: int, columns: Sequence[str]) -> DataFrame:
    """The chosen columns of one year."""
    return df.where(F.col("year") == year).select(*columns)


def price_series(graph: DataFrame, districts: Sequence[str]) -> DataFrame:
    """The price chart of the chosen districts, with the year as a date."""
    return in_districts(graph, districts, "postcode_district").withColumn("year", year_start("year"))


def scatter_rows(df: DataFrame, x: str, y: str) -> DataFrame:
    """District with any two of its columns."""
    return df.select("PostDist", F.col(x).alias("x"), F.col(y).alias("y"))


def value_domain(df: DataFrame, variable: str) -> DataFrame:
    """One row: the smallest and largest value of a variable."""
    return df.agg(F.min(variable).alias("low"), F.max(variable).alias("high"))


def color_scale(df: DataFrame, variable: str, keys: Sequence[str] = ("PostDist",)) -> DataFrame:
    """Each row's value and its place between the smallest (0) and the largest (1).

    The rows are stored once: the value domain is read from them and not computed a second time.
    """
    if variable not in names.numeric_columns(df):
        raise ValueError(f"no numeric column: {variable}")
    df = stored(df.select(*keys, variable), "scale")
    domain = value_domain(df, variable)
    low, high = domain.select("low").scalar(), domain.select("high").scalar()
    return df.select(
        *keys,
        F.col(variable).alias("value"),
        F.try_divide((F.col(variable) - low).cast("double"), (high - low).cast("double")).alias("scaled"),
    )


def filter_options(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The sorted distinct values of several columns, as (option, value, position), in one pass."""
    entries = [
        F.struct(F.lit(option).alias("option"), F.col(column).cast("string").alias("value"))
        for option, column in columns.items()
    ]
    distinct = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull()).distinct()
    return distinct.withColumn("position", F.row_number().over(Window.partitionBy("option").orderBy("value")))
