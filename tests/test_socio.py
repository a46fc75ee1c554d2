import math

import pytest
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.operators import socio, spatial
from propstats.schema import INDICATORS, POPULATION_COLUMNS


def small_areas(spark, rows):
    """Rows (district, code, name, score, rank): every indicator has the same score and rank."""
    df = spark.createDataFrame(rows, "PostDist string, LSOACode string, LADName string, s double, r int")
    facts = {f"{i}{kind}": F.col(c) for i in INDICATORS for kind, c in (("Score", "s"), ("Rank", "r"))}
    return df.withColumns(facts | {c: F.lit(10) for c in POPULATION_COLUMNS}).drop("s", "r")


def square(spark, code, srid=27700, column="PostDist", x0=0.0, side=1000.0):
    df = spark.createDataFrame([(code, srid)], f"{column} string, srid int")
    return df.withColumn("geometry", geo.box(F.lit(x0), F.lit(0.0), F.lit(x0 + side), F.lit(side)))


def test_nan_counts_as_missing_and_the_lowest_code_gives_the_name(spark):
    rows = [
        ("A1", "E01000006", "south", 1.0, 1), ("A1", "W01000001", "wales", math.nan, 2), ("A1", "E01000005", "north", 3.0, None),
        ("B1", "W2", "only", None, None),
    ]
    districts = socio.district_layer(square(spark, "A1").unionByName(square(spark, "B1")))
    rolled = {r.PostDist: r for r in socio.roll_up(small_areas(spark, rows), districts).collect()}
    a, b = rolled["A1"], rolled["B1"]
    assert (a.AreaName, a.CountLowLevelAreas, a.srid, a.TotalPopulation) == ("north", 3, 27700, 30)
    assert (a.CrimeAvg, a.CrimeMedian, a.CrimeMin, a.CrimeMax, a.CrimeRankAvg) == (2.0, 2.0, 1.0, 3.0, 1.5)
    assert (b.AreaName, b.CrimeAvg, b.CrimeMedian, b.CrimeRankAvg, b.TotalPopulation) == ("only", None, None, None, 10)


def test_floats_are_cleaned_too(spark):
    df = spark.createDataFrame([(math.nan, math.nan, "x")], "f float, d double, s string")
    assert tuple(socio.clean_indicators(df).head()) == (None, None, "x")


def test_layers_in_different_systems_do_not_join(spark):
    zone = square(spark, "Z", 4326, "LSOACode", 10.0, 5.0)
    with pytest.raises(ValueError, match="reference system"):
        socio.place_in_districts(zone, square(spark, "A1"))
    assert socio.place_in_districts(zone.withColumn("srid", F.lit(27700)), square(spark, "A1")).count() == 1


def test_boxes_are_as_tolerant_as_the_exact_test(spark):
    edge = square(spark, "Z", 27700, "LSOACode", 1000.0 - 5.0 + 1e-9, 5.0)
    assert socio.place_in_districts(edge, square(spark, "A1")).count() == 1
    assert spatial.within_join(edge, square(spark, "A1"), ["PostDist"], broadcast_bytes=0).count() == 1
    beyond = square(spark, "Z", 27700, "LSOACode", 1000.0 - 5.0 + 1e-3, 5.0)
    assert socio.place_in_districts(beyond, square(spark, "A1")).count() == 0


def test_scores_too_large_for_a_decimal_still_have_a_mean(spark):
    rows = [("A1", "E1", "a", 1e14, 1), ("A1", "E2", "b", 3e14, 1), ("B1", "E3", "c", 1e300, 1), ("C1", "E4", "d", 2.0, 1), ("C1", "E5", "e", -1e13, 1)]
    layer = square(spark, "A1").unionByName(square(spark, "B1")).unionByName(square(spark, "C1"))
    rolled = {r.PostDist: r.CrimeAvg for r in socio.roll_up(small_areas(spark, rows), socio.district_layer(layer)).collect()}
    assert rolled["A1"] == 2e14 and rolled["B1"] == pytest.approx(1e300) and rolled["C1"] == pytest.approx(-5e12)
