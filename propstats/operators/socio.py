"""Small-area indicators: joined to polygons, placed in districts, rolled up per district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.functions.labels import guarded_percent, guarded_ratio, nan_to_null, round_half_up
from propstats.operators.spatial import within_join
from propstats.schema import INDICATORS, POPULATION_COLUMNS
from propstats.sources.tables import stored

RANKS = [f"{name}Rank" for name in INDICATORS]


def clean_indicators(facts: DataFrame) -> DataFrame:
    """Turn NaN into null, which every aggregate then skips."""
    doubles = [name for name, kind in facts.dtypes if kind in ("double", "float")]
    return facts.withColumns({name: nan_to_null(name) for name in doubles})


def with_indicators(polygons: DataFrame, facts: DataFrame, polygon_key: str, fact_key: str = "LSOACode") -> DataFrame:
    """Inner join of small-area polygons and indicators on their codes."""
    if polygon_key == fact_key:
        return polygons.join(facts, polygon_key)
    return polygons.join(facts, F.col(polygon_key) == F.col(fact_key))


def unmatched_codes(polygons: DataFrame, facts: DataFrame, polygon_key: str, fact_key: str = "LSOACode") -> DataFrame:
    """How many small areas the inner join loses on either side: codes change between releases."""
    keys = polygons.select(F.col(polygon_key).alias("key"), F.lit(1).alias("side")).unionByName(
        facts.select(F.col(fact_key).alias("key"), F.lit(2).alias("side"))
    )
    sides = keys.groupBy("key").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return sides.agg(
        F.count_if(F.col("low") != F.col("high")).alias("matched"),
        F.count_if(F.col("high") == 1).alias("polygons_only"),
        F.count_if(F.col("low") == 2).alias("indicators_only"),
    )


def place_in_districts(zones: DataFrame, districts: DataFrame, how: str = "inner") -> DataFrame:
    """Small areas with the district they lie within; one across a border belongs to none."""
    return within_join(zones, districts, ["PostDist"], how)


def district_layer(districts: DataFrame) -> DataFrame:
    """Districts with their area; call it before any reprojection."""
    return districts.withColumn("AreaKm2", geo.area_km2("geometry"))


def roll_up(placed: DataFrame, districts: DataFrame) -> DataFrame:
    """One row per district with small areas: counts, population, shares, density, indicator statistics.

    NaN counts as missing. Medians need all values of a district, and a district may hold a third of
    all areas. So the scores are first counted per (district, indicator, score) with map-side combining,
    and the median is read off the running count of a district's distinct scores, indicator by
    indicator. Counts, sums and the area name (that of the lowest code) come from a grouping of their own.
    ``placed`` is read twice: hand in a stored table.
    """
    placed = clean_indicators(placed)
    entries = ", ".join(f"'{name}', CAST({name}Score AS DOUBLE)" for name in INDICATORS)
    counted = (
        placed.select("PostDist", F.expr(f"stack({len(INDICATORS)}, {entries}) AS (_indicator, _score)"))
        .where(F.col("_score").isNotNull())
        .groupBy("PostDist", "_indicator", "_score")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    code = F.col("LSOACode").cast("string")
    measures = placed.groupBy("PostDist").agg(
        F.min(F.struct(code.alias("code"), F.col("LADName").alias("name")))["name"].alias("AreaName"),
        F.count(F.lit(1)).alias("CountLowLevelAreas"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in POPULATION_COLUMNS],
        *[round_half_up(F.try_divide(F.sum(c), F.count(c))).alias(f"{c}Avg") for c in RANKS],
    )

    by_score = Window.partitionBy("PostDist", "_indicator").orderBy("_score")
    ranked = counted.withColumns(
        {
            "_below": F.sum("_n").over(by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_all": F.sum("_n").over(
                by_score.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )
    # The middle two values of an even count; of an odd one, twice the same.
    lower, upper = F.col("_below") * 2 >= F.col("_all"), F.col("_below") * 2 > F.col("_all")

    scores: list[Column] = []
    for name in INDICATORS:
        score = F.when(F.col("_indicator") == name, F.col("_score"))
        weight = F.when(F.col("_indicator") == name, F.col("_n")).otherwise(F.lit(0))
        # Summed as decimals, so that the mean does not depend on the order rows arrive in; what is too large for one, as doubles.
        small = F.abs(score) < 1e11
        exact = F.sum(F.when(small, score).cast("decimal(20,8)") * F.col("_n").cast("decimal(15,0)")).cast("double")
        total_score = F.coalesce(exact, F.lit(0.0)) + F.coalesce(F.sum(F.when(~small, score * F.col("_n"))), F.lit(0.0))
        scores += [
            round_half_up(F.try_divide(total_score, F.sum(weight))).alias(f"{name}Avg"),
            round_half_up((F.min(F.when(lower, score)) + F.min(F.when(upper, score))) / 2).alias(f"{name}Median"),
            round_half_up(F.min(score)).alias(f"{name}Min"),
            round_half_up(F.max(score)).alias(f"{name}Max"),
        ]
    rolled = measures.join(ranked.groupBy("PostDist").agg(*scores), "PostDist", "left")
    total = F.col("TotalPopulation")
    shares = [guarded_percent(F.col(m), total).alias(f"{m}%") for m in POPULATION_COLUMNS[1:]]
    reference = [c for c in ("srid",) if c in districts.columns]
    layer = districts.select("PostDist", "geometry", "AreaKm2", *reference)
    statistics = [f"{name}{kind}" for name in INDICATORS for kind in ("Avg", "Median", "Min", "Max", "RankAvg")]
    return rolled.join(layer, "PostDist").select(
        "PostDist",
        "geometry",
        *reference,
        "AreaName",
        "CountLowLevelAreas",
        "AreaKm2",
        *POPULATION_COLUMNS,
        *shares,
        guarded_ratio(total, F.col("AreaKm2")).alias("PopulationDensity"),
        *statistics,
    )


def district_socio(zones: DataFrame, districts: DataFrame) -> DataFrame:
    """Place the small areas, store where they lie, then roll them up."""
    layer = district_layer(districts)
    columns = ["PostDist", "LSOACode", "LADName", *POPULATION_COLUMNS, *RANKS, *[f"{name}Score" for name in INDICATORS]]
    placed = place_in_districts(zones, layer).select(*columns)
    return roll_up(stored(placed, "placed"), layer)
