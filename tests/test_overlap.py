import math
import random

import pytest
from pyspark.sql import functions as F

from propstats.operators import overlap
from tests.test_geometry import CONCAVE_HOLE, HOLED, SQUARE, TRIANGLE, TWO_PARTS, U_SHAPE, box, layer, polygon_around, ring
from tests.test_repair import geo_area, inside, plain


def shared(spark, small, large):
    rows = overlap.with_shares(layer(spark, small), layer(spark, large, "code"), ["code"]).collect()
    assert len(rows) == len({(r.id, r.code) for r in rows})
    return {(r.id, r.code): r for r in rows}


SHAPES = {"square": SQUARE, "holed": HOLED, "u": U_SHAPE, "concave": CONCAVE_HOLE, "parts": TWO_PARTS, "triangle": TRIANGLE}


def test_known_areas(spark):
    small = [
        ("corner", box(90, 90, 110, 110)), ("all", box(-10, -10, 110, 110)), ("middle", box(30, 30, 70, 70)), ("touches", box(100, 0, 120, 20)),
        ("clockwise", [[list(reversed(ring((0, 0), (10, 0), (10, 10), (0, 10))))]]), ("far", box(500, 500, 510, 510)), ("none", None),
        ("frame", [[ring((-10, -10), (110, -10), (110, 110), (-10, 110)), ring((10, 10), (10, 90), (90, 90), (90, 10))]]),
    ]
    got = {k: r.shared_area for k, r in shared(spark, small, list(SHAPES.items())).items()}
    full = {k: geo_area(plain(g)) for k, g in SHAPES.items()}
    assert {k: got["all", k] for k in SHAPES} == pytest.approx(full)
    assert got["corner", "square"] == 100 and got["middle", "holed"] == 1200 and got["middle", "u"] == 1600 - 20 * 30
    assert [got["clockwise", "square"], got["frame", "square"]] == pytest.approx([100, 3600])
    assert not [k for k in got if k[0] in ("touches", "far", "none")]


def test_random_polygons_by_sampling_and_symmetry(spark):
    rng = random.Random(5)
    shapes = lambda n, r, points: [(str(i), polygon_around(rng, rng.random() * 60, rng.random() * 60, r, points)) for i in range(n)]
    small, large = shapes(25, 14, 9), shapes(9, 30, 14) + [("holed", HOLED), ("comb", U_SHAPE)]
    one = shared(spark, small, large)
    other = shared(spark, large, [(k, g) for k, g in small])
    assert {k: r.shared_area for k, r in one.items()} == pytest.approx({(k[1], k[0]): r.shared_area for k, r in other.items()}, abs=1e-6)
    dots = [(rng.random() * 130 - 35, rng.random() * 130 - 35) for _ in range(4000)]
    for i, g in small[:6]:
        for j, h in large:
            hits = sum(inside(plain(g), x, y) and inside(plain(h), x, y) for x, y in dots)
            area = one[i, j].shared_area if (i, j) in one else 0.0
            assert abs(area - hits * 130 * 130 / 4000) < 5 * 130 * 130 * math.sqrt(max(hits, 1)) / 4000 + 1


def test_shares_add_up_where_containers_tile(spark):
    rng = random.Random(6)
    # Tiles whose common borders are crooked lines.
    xs = [0, 33.3, 71, 100]
    line = {x: [(x, 0.0)] + [(x + rng.uniform(-5, 5), y) for y in range(10, 100, 10)] + [(x, 100.0)] for x in xs[1:3]} | {x: [(x, 0.0), (x, 100.0)] for x in (0, 100)}
    tiles = [(f"t{i}", [[ring(*line[a], *reversed(line[b]))]]) for i, (a, b) in enumerate(zip(xs, xs[1:]))]
    small = [(str(i), polygon_around(rng, 21 + rng.random() * 58, 21 + rng.random() * 58, 14, 11)) for i in range(40)]
    total = {}
    for (i, _), r in shared(spark, small, tiles).items():
        total[i] = total.get(i, 0) + r.share
    assert total == pytest.approx({i: 1.0 for i, _ in small})


def test_left_join_counts_and_other_columns(spark):
    small = layer(spark, [("in", box(1, 1, 3, 3)), ("across", box(8, 0, 12, 4)), ("out", box(50, 50, 60, 60)), ("none", None)]).withColumns({"a": F.lit(8), "p": F.lit(1), "slab": F.lit("s")})
    large = layer(spark, [("l", box(0, 0, 10, 10)), ("r", box(10, 0, 20, 10))], "code").withColumn("id", F.lit(7))
    rows = overlap.with_shares(small, large, ["code"], "left")
    assert rows.columns == [*small.columns, "code", "shared_area", "share"]
    assert {(r.id, r.code, r.share) for r in rows.collect()} == {("in", "l", 1.0), ("across", "l", 0.5), ("across", "r", 0.5), ("out", None, None), ("none", None, None)}
    counts = overlap.apportioned(rows.where("code IS NOT NULL"), "code", ["a"])
    assert {(r.code, r.a) for r in counts.collect()} == {("l", 12.0), ("r", 4.0)}
    assert overlap.with_shares(small.limit(0), large, ["code"]).count() == 0
    assert overlap.with_shares(small, large.limit(0), ["code"], "left").count() == 4


def test_layers_of_different_systems_do_not_meet(spark):
    one = layer(spark, [("a", SQUARE)])
    with pytest.raises(ValueError):
        overlap.with_shares(one.withColumn("srid", F.lit(1)), one.withColumn("srid", F.lit(2)), [])
