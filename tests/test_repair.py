import random

import pytest
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.operators import repair, validity
from tests.test_geometry import HOLED, SQUARE, TWO_PARTS, box, layer, ring

NAN, INF = float("nan"), float("inf")


def crosses(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


def inside(geometry, x, y):
    return any(crosses(part[0], x, y) and not any(crosses(hole, x, y) for hole in part[1:]) for part in geometry)


def plain(geometry):
    return [[[(p["x"], p["y"]) for p in points] for points in part] for part in geometry]


def mend(spark, rows):
    df = layer(spark, rows)
    new = repair.mended(df, validity.report(df, "id"), "id").withColumn("area", geo.area("geometry"))
    after = validity.report(new, "id")
    return {r.id: r for r in new.join(after.select("id", "reason"), "id").collect()}


CASES = {
    "bow tie": ([[ring((0, 0), (10, 10), (10, 0), (0, 10))]], 50),
    "eight": ([[ring((0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5))]], 50),
    "spike": ([[ring((0, 0), (10, 0), (10, 10), (10, 15), (10, 10), (0, 10))]], 100),
    "hole out": ([[*SQUARE[0], ring((200, 0), (200, 9), (209, 9))]], 10000),
    "hole across": ([[*SQUARE[0], ring((90, 40), (90, 60), (110, 60), (110, 40))]], 9800),
    "holes nested": ([[*HOLED[0], ring((45, 45), (45, 55), (55, 55))]], 9600),
    "parts overlap": (box(0, 0, 10, 10) + box(5, 5, 15, 15), 175),
    "part inside": (box(0, 0, 10, 10) + box(2, 2, 4, 4), 100),
    "part twice": (box(0, 0, 10, 10) + box(0, 0, 10, 10), 100),
    "parts share a side": (box(0, 0, 10, 10) + box(10, 0, 20, 10), 200),
    "part over hole": (HOLED + box(30, 45, 70, 55), 9800),
    "island in hole": (HOLED + box(45, 45, 55, 55) + box(90, 90, 110, 110), 9600 + 100 + 300),
    "cut by a hole": ([[ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((5, 0), (4, 5), (5, 10), (6, 5))]], 90),
    "open": ([[SQUARE[0][0][:-1]]], 10000),
    "fine": (TWO_PARTS, 9000),
}


def test_mended_areas(spark):
    found = mend(spark, [(k, g) for k, (g, _) in CASES.items()])
    assert {k: (r.reason, r.area) for k, r in found.items()} == {k: ("Valid", area) for k, (_, area) in CASES.items()}
    assert len(found["cut by a hole"].geometry) == 2 and len(found["part over hole"].geometry[0]) == 3
    # What was valid is not redrawn.
    assert plain(found["fine"].geometry) == plain(TWO_PARTS)


def test_random_scrawls_keep_the_area_their_rings_describe(spark):
    rng = random.Random(11)
    dots = lambda n, size: [(rng.randint(0, size), rng.randint(0, size)) for _ in range(n)]
    rows = []
    for i in range(60):
        size = 12 if i % 2 else 1000
        parts = [[ring(*dots(rng.randint(3, 9), size)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 2))]
        rows.append((f"g{i}", parts))
    found = mend(spark, rows)
    for name, parts in rows:
        r = found[name]
        if r.reason != "Valid":
            assert r.reason in ("Zero area", "Too few points", "Empty geometry"), (name, r.reason, parts)
            continue
        drawn, parts = plain(r.geometry), plain(parts)
        size = max(x for part in parts for points in part for x, _ in points)
        for _ in range(200):
            x, y = rng.random() * size, rng.random() * size
            assert inside(drawn, x, y) == inside(parts, x, y), (name, x, y)


def test_what_cannot_be_mended_stays(spark):
    rows = [
        ("none", []),
        ("null", None),
        ("flat", [[ring((0, 0), (5, 0), (10, 0))]]),
        ("short", [[ring((0, 0), (5, 0))]]),
        ("not a number", [[ring((0, 0), (NAN, 0), (10, 10))]]),
        ("endless", [[ring((0, 0), (INF, 0), (10, 10))]]),
        ("huge", [[ring((0, 0), (1e300, 0), (10, 10))]]),
    ]
    found = mend(spark, rows)
    assert {k: r.reason for k, r in found.items()} == {
        "none": "Empty geometry", "null": "Empty geometry", "flat": "Zero area", "short": "Too few points",
        "not a number": "Coordinates not finite", "endless": "Coordinates not finite", "huge": "Coordinates not finite",
    }
    assert mend(spark, rows[:0]) == {}


def test_interiors(spark):
    outer = ring((0, 0), (20, 0), (20, 20), (0, 20))
    cases = {
        "hole touches twice": ([outer, ring((10, 0), (8, 10), (10, 20), (12, 10))], False),
        "hole touches once": ([outer, ring((10, 0), (8, 10), (12, 10))], True),
        "two holes meet twice": ([outer, ring((4, 10), (10, 14), (16, 10), (10, 12)), ring((4, 10), (10, 8), (16, 10), (10, 4))], False),
        "two holes meet once": ([outer, ring((4, 10), (10, 14), (10, 12)), ring((4, 10), (10, 8), (10, 4))], True),
        "chain of holes to the border": (
            [outer, ring((0, 10), (5, 12), (5, 8)), ring((5, 12), (10, 16), (10, 12)), ring((10, 16), (12, 20), (14, 18))],
            False,
        ),
        "chain of holes short of the border": (
            [outer, ring((0, 10), (5, 12), (5, 8)), ring((5, 12), (10, 16), (10, 12)), ring((10, 16), (12, 19), (14, 18))],
            True,
        ),
    }
    df = layer(spark, [(k, [rings]) for k, (rings, _) in cases.items()])
    got = {r.id: r.reason for r in validity.report(df, "id").collect()}
    assert got == {k: "Valid" if fine else "Interior is disconnected" for k, (_, fine) in cases.items()}
    found = mend(spark, [(k, [rings]) for k, (rings, _) in cases.items()])
    assert {r.reason for r in found.values()} == {"Valid"}
    assert {k for k, r in found.items() if len(r.geometry) == 2} == {k for k, (_, fine) in cases.items() if not fine}


def test_long_borders_are_traced(spark):
    # Two combs of 300 teeth each that overlap: every tooth of one crosses the other.
    def comb(turned):
        points = [(0.0, 0.0)] + [(float(i), 10.0 if i % 2 else 3.0) for i in range(1, 601)] + [(600.0, 0.0)]
        return [(x, 12 - y) for x, y in points] if turned else points

    found = mend(spark, [("combs", [[ring(*comb(False))], [ring(*comb(True))]])])["combs"]
    assert found.reason == "Valid"
    one = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(comb(False), comb(False)[1:] + comb(False)[:1])) / 2
    assert abs(one) < found.area < 600 * 12
    rng = random.Random(2)
    both, drawn = plain([[ring(*comb(False))], [ring(*comb(True))]]), plain(found.geometry)
    for _ in range(300):
        x, y = rng.random() * 600, rng.random() * 12
        assert inside(drawn, x, y) == inside(both, x, y)
    assert found.area == pytest.approx(geo_area(drawn))


def geo_area(geometry):
    def shoelace(points):
        return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:]))) / 2

    return sum(shoelace(part[0]) - sum(map(shoelace, part[1:])) for part in geometry)


def test_bounds_and_other_columns_are_kept(spark):
    df = layer(spark, [("tie", CASES["bow tie"][0]), ("ok", SQUARE)]).withColumns({"min_x": F.lit(-9.0), "min_y": F.lit(-9.0), "max_x": F.lit(99.0), "max_y": F.lit(99.0), "ring": F.lit("x")})
    new = repair.mended(df, validity.report(df, "id"), "id")
    assert new.columns == df.columns
    assert {(r.id, r.min_x, r.max_y, r.ring) for r in new.collect()} == {("tie", 0.0, 10.0, "x"), ("ok", 0.0, 100.0, "x")}


def test_pairs_of_edges_are_joined_once_by_their_boxes_only(spark):
    df = layer(spark, [("tie", CASES["bow tie"][0])])
    edges = validity.edges_of(df.select("id", "geometry"), "id", "geometry")
    for pairs in (repair._pieces(edges, "id"), validity._meetings(edges, "id")):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        # In the condition the tests would be repeated for every use, too long a method to be compiled.
        assert len(joins) == 1 and "SIGNUM" not in joins[0] and "lambda" not in joins[0]


def test_few_and_many_edges_meet_alike(spark):
    # The same bow tie with its sides in one piece each (all compared in one cell) and in 32 (compared by cells of a grid).
    corners = [(0, 0), (64, 64), (64, 0), (0, 64), (0, 0)]
    many = [(x1 + (x2 - x1) * i / 32, y1 + (y2 - y1) * i / 32) for (x1, y1), (x2, y2) in zip(corners, corners[1:]) for i in range(32)]
    found = mend(spark, [("few", [[ring(*corners[:-1])]]), ("many", [[ring(*many)]])])
    assert {(r.reason, r.area, len(r.geometry)) for r in found.values()} == {("Valid", 2048.0, 2)}


def test_a_hole_in_rows_that_its_shell_does_not_reach(spark):
    shell = [ring((0, 0), (10, 0), (10, 10), (0, 10))]
    far = ring((200, 200), (200, 209), (209, 209))
    df = layer(spark, [("far", [[*shell, far]]), ("twice", [[*shell, far, far]]), ("fine", [[*shell, ring((2, 2), (2, 4), (4, 4))]])])
    assert {r.id: r.reason for r in validity.report(df, "id").collect()} == {
        "far": "Hole lies outside shell", "twice": "Rings cross", "fine": "Valid",
    }
