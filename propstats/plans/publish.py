"""Silver sales and polygon layers to the published gold tables and marts.

Every stage writes a table and the next one reads it back, so no result is computed twice and a
lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propstats.operators import marts, qa, quality, sketches, socio
from propstats.operators.quality import GOLD_THRESHOLDS
from propstats.operators.spatial import require_same_srid
from propstats.plans import areas, gold
from propstats.schema import LEVELS
from propstats.session import owns_scratch
from propstats.sources import tables


def publish_gold(
    spark: SparkSession, silver: DataFrame, path: str, thresholds: Mapping[str, float] = GOLD_THRESHOLDS
) -> DataFrame:
    """The trend table of all levels, partitioned by level; reading one level skips the others."""
    trends = gold.all_level_trends(silver, thresholds)
    trends.write.mode("overwrite").partitionBy("level").parquet(path)
    return tables.read_table(spark, path)


def gold_level(gold_table: DataFrame, level: str) -> DataFrame:
    """One level of the gold table with only the codes that level has."""
    unused = [c for c in LEVELS["sector"] if c not in LEVELS[level]]
    return gold_table.where(F.col("level") == level).drop("level", *unused)


def post_filter(trends: DataFrame, latest_year: int, low_volume: int, since_year: int, property_type: str = "F") -> dict[str, DataFrame]:
    """What is filtered and ranked after publishing, from the district trends.

    Counts per type in the latest year, districts of one type without those that ever sold too little since
    a year, their ranking by the latest five-year growth, and the columns of the price chart.
    """
    kept = quality.drop_low_volume(trends.where(F.col("property_type") == property_type), low_volume, since_year)
    return {
        "type_counts_latest": marts.type_counts(trends, latest_year),
        "trends_kept": kept,
        "hotspots": marts.hotspots(kept, latest_year),
        "price_graph": marts.price_graph(kept),
    }


@owns_scratch
def publish(
    spark: SparkSession,
    silver: DataFrame,
    zones: DataFrame,
    districts: DataFrame,
    path: str,
    csv_export: bool = False,
    latest_year: int | None = None,
    low_volume: int = 5,
    single_csv: bool = False,
) -> dict[str, str]:
    """Write every gold table and mart below ``path`` and return where each one lies.

    ``latest_year`` is that of the rankings; by default the last one with sales. ``single_csv``
    exports each level as one file, for programs that want it so.
    """
    root = path.rstrip("/")
    written: dict[str, str] = {}

    def store(name: str, df: DataFrame) -> DataFrame:
        written[name] = f"{root}/{name}"
        tables.write_table(df, written[name])
        return tables.read_table(spark, written[name])

    require_same_srid(zones, districts)
    written["gold"] = f"{root}/gold"
    trends = gold_level(publish_gold(spark, silver, written["gold"]), "district")

    written["price_sketches"] = f"{root}/price_sketches"
    tables.write_by_year(sketches.price_sketches(silver), written["price_sketches"])

    layer = socio.district_layer(districts)
    placed = store("zones_placed", socio.place_in_districts(zones, layer, "left"))
    in_district = placed.where(F.col("PostDist").isNotNull())
    indicators = store("district_socio", socio.roll_up(in_district, layer))
    joined = store("district_trends_with_socio", marts.trends_with_socio(trends, indicators.drop("geometry")))

    if latest_year is None:
        latest_year = trends.agg(F.max("year")).head()[0]
    if latest_year is not None:
        for name, df in post_filter(trends, latest_year, low_volume, latest_year - 1).items():
            store(name, df)

    for name, kind in (("london", None), ("london_flats", "F")):
        rows = store(f"trends_{name}", marts.in_london(joined, kind))
        store(f"zones_{name}", marts.rows_with_key_in(placed, rows))
        store(f"type_counts_{name}", marts.type_counts(rows))
        store(f"price_graph_{name}", marts.price_graph(rows))
    flats = tables.read_table(spark, written["trends_london_flats"])
    geometry = store("mart_geometry", marts.geometry_mart(indicators, flats))
    store("mart_geometry_wgs84", areas.in_degrees(geometry))
    store("mart_series", marts.series_mart(flats))
    store("district_numbering", qa.district_numbering(trends))
    if csv_export:
        written["csv_export"] = f"{root}/csv"
        for level in LEVELS:
            tables.write_csv(
                gold_level(tables.read_table(spark, written["gold"]), level),
                f"{written['csv_export']}/{level}_pct_change",
                single_file=single_csv,
            )
    return written
