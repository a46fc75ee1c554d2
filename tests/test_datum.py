import pytest
from pyspark.sql import functions as F

from propstats.functions import projection
from propstats.operators import datum
from tests.test_geometry import layer, ring

GRID = datum.ShiftGrid(-0.2, 51.4, 0.05, 0.04)


def shift(lon, lat):
    """Linear in both, with a product: what four nodes interpolate exactly."""
    return 1e-3 + 2e-3 * lon - 3e-4 * lat + 1e-3 * lon * (lat - 51), -5e-4 + 1e-3 * lon * (lat - 51) + 2e-5 * lat


def nodes(spark, missing=()):
    rows = []
    for col in range(7):
        for row in range(9):
            d_lon, d_lat = shift(GRID.lon0 + col * GRID.step_lon, GRID.lat0 + row * GRID.step_lat)
            rows.append((col, row, None if (col, row) in missing else d_lon, d_lat))
    return spark.createDataFrame(rows, "col int, row int, d_lon double, d_lat double")


def at(x, y):
    return [[ring((x, y), (x + 900, y), (x + 900, y + 700), (x, y + 700))]]


# The grid covers about 525,000 to 546,000 east, 168,000 to 204,000 north.
SHAPES = [("inside", at(531000, 174000)), ("across its border", at(524600, 180000)), ("outside", at(400000, 300000)), ("none", None), ("empty", []), ("by a missing node", at(530000, 186000))]


def points(df, column):
    rows = df.select("id", F.posexplode_outer(F.flatten(F.flatten(column))).alias("i", "p")).collect()
    return {(r.id, r.i): (r.p.x, r.p.y) for r in rows if r.p}


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_points_move_by_the_grid_or_by_the_series(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    df = layer(spark, SHAPES).withColumns({"col": F.lit("kept"), "shifts": F.lit(1)})
    missing = {(2, 3)}
    moved = datum.reproject_by_grid(df, nodes(spark, missing), GRID)
    assert moved.columns == df.columns and moved.count() == len(SHAPES)
    assert {r.id: r.geometry for r in moved.where("id IN ('none', 'empty')").collect()} == {"none": None, "empty": []}
    got = points(moved, "geometry")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    old = points(df.select("id", F.transform("geometry", lambda part: F.transform(part, projection.grid_to_airy)).alias("g")), "g")
    series = points(df.select("id", projection.reproject("geometry").alias("g")), "g")
    kinds = {}
    for key, (lon, lat) in old.items():
        col, row = (lon - GRID.lon0) // GRID.step_lon, (lat - GRID.lat0) // GRID.step_lat
        covered = 0 <= col < 6 and 0 <= row < 8 and not {(col, row), (col + 1, row), (col, row + 1), (col + 1, row + 1)} & missing
        d_lon, d_lat = shift(lon, lat)
        assert got[key] == pytest.approx((lon + d_lon, lat + d_lat) if covered else series[key], abs=1e-12), key
        kinds.setdefault(key[0], set()).add(covered)
    assert kinds["inside"] == {True} and kinds["outside"] == {False} and kinds["across its border"] == {True, False}


def test_an_empty_grid_leaves_the_series(spark):
    df = layer(spark, SHAPES)
    moved = datum.reproject_by_grid(df, nodes(spark).limit(0), GRID)
    assert points(moved, "geometry") == points(df.select("id", projection.reproject("geometry").alias("geometry")), "geometry")
    assert datum.reproject_by_grid(df.limit(0), nodes(spark), GRID).count() == 0
