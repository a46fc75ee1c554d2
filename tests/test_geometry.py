import math
import random

import pytest
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.functions import projection
from propstats.operators import spatial, validity
from propstats.schema import GEOMETRY_TYPE
from propstats.sources import polygons


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def box(x0, y0, x1, y1):
    return [[ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def layer(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} string, geometry {GEOMETRY_TYPE.simpleString()}")


SQUARE = box(0, 0, 100, 100)
HOLED = [[*SQUARE[0], ring((40, 40), (40, 60), (60, 60), (60, 40))]]
U_SHAPE = [[ring((0, 0), (100, 0), (100, 100), (60, 100), (60, 40), (40, 40), (40, 100), (0, 100))]]
CONCAVE_HOLE = [[*SQUARE[0], ring((20, 20), (20, 80), (80, 80), (80, 70), (30, 70), (30, 20))]]
TWO_PARTS = box(0, 0, 45, 100) + box(55, 0, 100, 100)
TRIANGLE = [[ring((0, 0), (100, 0), (50, 100))]]

CASES = [
    ("touches border", box(0, 10, 20, 30), SQUARE, True),
    ("equal", SQUARE, SQUARE, True),
    ("straddles", box(90, 10, 110, 30), SQUARE, False),
    ("outside", box(200, 200, 210, 210), SQUARE, False),
    ("inside one arm of a U", box(5, 50, 35, 90), U_SHAPE, True),
    ("bridges the notch, corners on its edges", box(40, 60, 60, 80), U_SHAPE, False),
    ("bridges the notch", box(30, 60, 70, 80), U_SHAPE, False),
    ("below the notch", box(10, 0, 90, 40), U_SHAPE, True),
    ("around a hole", box(30, 30, 70, 70), HOLED, False),
    ("fills a hole", box(40, 40, 60, 60), HOLED, False),
    ("inside a hole", box(45, 45, 55, 55), HOLED, False),
    ("beside a hole", box(20, 20, 40, 80), HOLED, True),
    ("corner in a hole", box(30, 30, 50, 50), HOLED, False),
    ("ring with the same hole", [[ring((30, 30), (70, 30), (70, 70), (30, 70)), HOLED[0][1]]], HOLED, True),
    ("ring with a smaller hole", [[ring((30, 30), (70, 30), (70, 70), (30, 70)), ring((45, 45), (45, 55), (55, 55), (55, 45))]], HOLED, False),
    ("around a concave hole", box(10, 10, 90, 90), CONCAVE_HOLE, False),
    ("in the bay of a concave hole", box(30, 20, 90, 70), CONCAVE_HOLE, True),
    ("in the left part", box(10, 10, 45, 90), TWO_PARTS, True),
    ("across the gap", box(40, 10, 60, 20), TWO_PARTS, False),
    ("a part in each part", box(1, 1, 5, 5) + box(60, 1, 65, 5), TWO_PARTS, True),
    ("one part outside", box(1, 1, 5, 5) + box(46, 1, 50, 5), TWO_PARTS, False),
    ("outside a ring that repeats a point", box(90, 40, 110, 60), [[SQUARE[0][0][:2] + SQUARE[0][0][1:]]], False),
    ("inside a ring that repeats a point", box(10, 10, 20, 20), [[SQUARE[0][0][:2] + SQUARE[0][0][1:] + SQUARE[0][0][:1]]], True),
    ("corner past a slope", box(0, 0, 20, 20), TRIANGLE, False),
    ("corner on a slope", box(20, 0, 80, 40), TRIANGLE, True),
    ("edge along a border that turns", [[ring((30, 30), (40, 40), (60, 40), (70, 30))]], [[ring((0, 0), (100, 0), (100, 100), (60, 100), (60, 40), (40, 40), (40, 100), (0, 100))]], True),
]


@pytest.mark.parametrize("name, inner, outer, expected", CASES, ids=[c[0] for c in CASES])
def test_within(spark, name, inner, outer, expected):
    pair = spark.createDataFrame(
        [(inner, outer)], f"a {GEOMETRY_TYPE.simpleString()}, b {GEOMETRY_TYPE.simpleString()}"
    )
    assert pair.withColumn("p", geo.prepare("b")).select(geo.within("a", "p").alias("w")).head().w is expected


def polygon_around(rng, cx, cy, radius, corners):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return [[ring(*[(cx + radius * (0.4 + rng.random()) * math.cos(t), cy + radius * (0.4 + rng.random()) * math.sin(t)) for t in turns])]]


def point_inside(x, y, points):
    inside = False
    for p, q in zip(points, points[1:]):
        if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
            inside = not inside
    return inside


def edges_cross(a, b, c, d):
    def side(p, q, r):
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def brute_within(small, large):
    """Rings in general position: all corners inside and no edges crossing."""
    a, b = small[0][0], large[0][0]
    if not all(point_inside(p["x"], p["y"], b) for p in a[:-1]):
        return False
    return not any(edges_cross(p, q, r, s) for p, q in zip(a, a[1:]) for r, s in zip(b, b[1:]))


@pytest.mark.parametrize("limit", [spatial.BROADCAST_BYTES, 0], ids=["broadcast", "shuffle"])
def test_join_against_brute_force_with_a_hot_cell(spark, limit):
    rng = random.Random(7)
    large = [(f"L{i}", polygon_around(rng, rng.random() * 400, rng.random() * 400, 60, 9)) for i in range(12)]
    # Nearly half of the small areas crowd around one spot.
    small = [
        (f"s{i}", polygon_around(rng, *((100, 100) if i % 2 else (rng.random() * 400, rng.random() * 400)), 4, 5))
        for i in range(160)
    ]
    small.append(("empty", None))
    expected = {(s, b) for s, g in small[:-1] for b, h in large if brute_within(g, h)}
    assert expected
    containers = layer(spark, large, "code")
    pairs = spatial.within_join(layer(spark, small), containers, ["code"], broadcast_bytes=limit)
    rows = [(r.id, r.code) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    left = spatial.within_join(layer(spark, small), containers, ["code"], "left", broadcast_bytes=limit)
    kept = [(r.id, r.code) for r in left.collect()]
    assert {k for k in kept if k[1]} == expected and {k for k, _ in kept} == {s for s, _ in small}
    joins = pairs._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in joins) != (limit == 0) and ("SortMergeJoin" in joins) == (limit == 0)


def test_a_giant_container_is_not_copied_into_small_cells(spark):
    unit = spark.range(400).selectExpr("concat('u', id) AS code", "id % 20 * 10D AS x", "floor(id / 20) * 10D AS y", "1D AS side")
    giant = spark.range(1).selectExpr("'giant' AS code", "-7D AS x", "-7D AS y", "1000D AS side")
    containers = unit.unionByName(giant).withColumn("geometry", geo.box(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side")))
    boxes = spatial.with_bounds(containers).withColumnsRenamed({c: f"_c_{c}" for c in ("min_x", "min_y", "max_x", "max_y")})
    assert spatial.container_cells(boxes).groupBy("code").count().agg(F.max("count")).head()[0] <= 4
    small = unit.select("code", geo.box(F.col("x") + 0.25, F.col("y") + 0.25, F.col("x") + 0.5, F.col("y") + 0.5).alias("geometry")).withColumnRenamed("code", "id")
    rows = [(r.id, r.code) for r in spatial.within_join(small, containers.select("code", "geometry"), ["code"]).collect()]
    assert sorted(rows) == sorted([(f"u{i}", f"u{i}") for i in range(400)] + [(f"u{i}", "giant") for i in range(400)])


def test_reference_systems_must_agree(spark):
    one = layer(spark, [("a", SQUARE)])
    assert spatial.with_srid(one).head().srid == 4326
    spatial.require_same_srid(spatial.with_srid(one), spatial.with_srid(one))
    with pytest.raises(ValueError):
        spatial.require_same_srid(spatial.with_srid(one), spatial.with_srid(one, 27700))


def test_measures(spark):
    df = layer(spark, [("square", SQUARE), ("holed", HOLED), ("u", U_SHAPE), ("parts", TWO_PARTS), ("triangle", TRIANGLE)])
    rows = {r.id: r for r in df.select("id", geo.area("geometry").alias("a"), geo.is_box("geometry").alias("b")).collect()}
    assert {k: r.a for k, r in rows.items()} == {"square": 10000, "holed": 9600, "u": 8800, "parts": 9000, "triangle": 5000}
    assert [k for k, r in rows.items() if r.b] == ["square"]
    whole = spatial.extent(df).head()
    assert (whole.min_x, whole.max_y, whole.center_x) == (0, 100, 50)


def test_validity_and_repair(spark):
    good = SQUARE[0][0]
    clockwise = [list(reversed(good))]
    rows = [
        ("ok", SQUARE, "Valid", "Valid"),
        ("open", [[good[:-1]]], "Ring not closed", "Valid"),
        ("repeat", [[good[:2] + good[1:]]], "Valid", "Valid"),
        ("bow tie", [[ring((0, 0), (10, 10), (10, 0), (0, 10))]], "Self-intersection", "Self-intersection"),
        ("flat", [[ring((0, 0), (5, 0), (10, 0))]], "Zero area", "Zero area"),
        ("short", [[ring((0, 0), (5, 0))]], "Too few points", "Too few points"),
        ("none", [], "Empty geometry", "Empty geometry"),
        ("clockwise", [clockwise], "Valid", "Valid"),
        ("eight", [[ring((0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5))]], "Self-intersection", "Self-intersection"),
        ("spike", [[ring((0, 0), (10, 0), (10, 10), (10, 15), (10, 10), (0, 10))]], "Self-intersection", "Self-intersection"),
        ("hole out", [[*SQUARE[0], ring((200, 0), (200, 9), (209, 9))]], "Hole lies outside shell", "Hole lies outside shell"),
        ("hole above", [[*SQUARE[0], ring((20, 200), (20, 209), (29, 209))]], "Hole lies outside shell", "Hole lies outside shell"),
        ("hole across", [[*SQUARE[0], ring((90, 40), (90, 60), (110, 50))]], "Rings cross", "Rings cross"),
        ("holes nested", [[*HOLED[0], ring((45, 45), (45, 55), (55, 55))]], "Nested holes", "Nested holes"),
        ("hole", HOLED, "Valid", "Valid"),
        ("concave", CONCAVE_HOLE, "Valid", "Valid"),
        ("parts", TWO_PARTS, "Valid", "Valid"),
        ("parts overlap", box(0, 0, 10, 10) + box(5, 5, 15, 15), "Overlapping parts", "Overlapping parts"),
        ("part inside", box(0, 0, 10, 10) + box(2, 2, 4, 4), "Overlapping parts", "Overlapping parts"),
        ("part in hole", HOLED + box(45, 45, 55, 55), "Valid", "Valid"),
        ("part twice", box(0, 0, 10, 10) + box(0, 0, 10, 10), "Overlapping parts", "Overlapping parts"),
        ("parts touch at a corner", box(0, 0, 10, 10) + box(10, 10, 20, 20), "Valid", "Valid"),
    ]
    df = layer(spark, [(r[0], r[1]) for r in rows])
    before = validity.report(df, "id").withColumnRenamed("reason", "before")
    mended = validity.repaired(df)
    after = validity.report(mended, "id").select("id", F.col("reason").alias("after"))
    got = before.join(after, "id").join(mended.withColumnRenamed("geometry", "fixed"), "id")
    found = {r.id: r for r in got.collect()}
    assert {k: (r.before, r.after) for k, r in found.items()} == {r[0]: (r[2], r[3]) for r in rows}
    assert {k: r.repeated_points for k, r in found.items() if r.repeated_points} == {"repeat": 1}
    turned = [(p.x, p.y) for p in found["clockwise"].fixed[0][0]]
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(turned, turned[1:])) > 0


def test_grid_worked_example(spark):
    grid = F.array(geo.point(F.lit(651409.903), F.lit(313177.270)))
    row = spark.range(1).select(projection.grid_to_airy(grid)[0].alias("airy"), projection.grid_to_wgs84(grid)[0].alias("wgs")).head()
    assert row.airy.y == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=1e-8)
    assert row.airy.x == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=1e-8)
    # The datum shift moves the point by about a hundred metres.
    assert 50 < math.hypot((row.wgs.y - row.airy.y) * 111_000, (row.wgs.x - row.airy.x) * 67_000) < 200


def test_geometry_survives_reprojection_and_geojson(spark, tmp_path):
    df = layer(spark, [("a", HOLED), ("b", TWO_PARTS)])
    shaped = df.select(projection.reproject("geometry").alias("g")).head().g
    assert [len(r) for r in shaped[0]] == [5, 5]
    polygons.write_geojson_lines(df, str(tmp_path / "layer"), ["id"])
    back = polygons.read_geojson_lines(spark, str(tmp_path / "layer"), "id string", 27700)
    assert back.select("id", "geometry").exceptAll(df).count() == 0 and back.count() == 2
    assert {r.srid for r in back.collect()} == {27700}
