"""Topological repair: the area that a polygon's rings describe, drawn anew with valid rings.

A point belongs to a part if a ray from it crosses the part's outer ring an odd number of times and each
of its holes an even number of times, and to the geometry if it belongs to any part. So both lobes of a bow
tie stay, spikes vanish, holes are cut off at the border, and parts that overlap become one.

1. Noding: edges that meet, found by a join on grid cells, are cut where they meet.
2. Sides: for the middle of each piece, the crossings of a ray with every ring are counted, by a join on the
   rows of the grid. A piece with the area on one side only is border; it is turned to have the area on its left.
3. Rings: each border piece is followed by the next one clockwise at its end. Rings are traced by
   doubling steps in stored rounds, cut where they come back to a point, and traced again.
4. Parts: rings that run counter-clockwise are outer ones; a hole goes to the smallest of those around it.

Every step is a join or a window over pieces; a geometry is one row again only at the end. What has no area is
left as it was. Crossing points are rounded to 2 ** -30 of a grid cell, so that edges
that cross in one point share it; check the outcome with ``validity.report``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.operators import validity
from propstats.operators.validity import GRID, TOUCHES, edge_pairs, edges_of
from propstats.sources.tables import Rounds, stored

_PIECE = ["ux", "uy", "vx", "vy"]


def _pieces(edges: DataFrame, key: str) -> DataFrame:
    """Edges cut wherever another one meets them, lower left end first, with their ring; even repeats within a ring cancel."""
    edge = [key, "part", "ring", "at"]
    pairs = edge_pairs(edges, key)
    # The same numbers for both edges: worked out once, from a, on a grid that a power of two divides.
    share = "((b_x1 - a_x1) * (b_y2 - b_y1) - (b_y1 - a_y1) * (b_x2 - b_x1)) / ((a_x2 - a_x1) * (b_y2 - b_y1) - (a_y2 - a_y1) * (b_x2 - b_x1))"
    step = "pow(2D, ceil(log2(greatest(a_cell, b_cell))) - 30)"
    crossing = ", ".join(f"'{c}', rint((a_{c}1 + share * (a_{c}2 - a_{c}1)) / step) * step" for c in "xy")
    ends = ", ".join(f"CASE WHEN {test} THEN named_struct('x', {x}, 'y', {y}) END" for test, (x, y) in TOUCHES.items())
    met = pairs.where(f"proper OR {' OR '.join(TOUCHES)}").withColumn("step", F.expr(step)).withColumn("share", F.expr(f"CASE WHEN proper THEN {share} END"))
    # Exploded as an expression: of a column, the filter for empty arrays would work the places out again, in the join.
    places = F.explode(F.expr(f"array(CASE WHEN share IS NOT NULL THEN named_struct({crossing}) END, {ends})"))
    names = ["part", "ring", "at", "x1", "y1", "x2", "y2", *GRID]
    both = F.explode(F.array(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in names]) for side in "ab"]))
    cuts = met.select(key, *[f"{side}_{c}" for side in "ab" for c in names], places.alias("p")).where("p IS NOT NULL").select(key, both.alias("e"), "p")
    own = edges.select(key, *names, F.explode(F.expr("array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2))")).alias("p"))
    nodes = cuts.select(key, "e.*", "p").unionByName(own).select(key, *names, "p.x", "p.y")
    along = (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    nodes = nodes.withColumn("along", along)
    following = Window.partitionBy(*edge).orderBy("along", "x", "y")
    # Repeats of a place come one after the other, and a piece from a place to itself is none.
    cut = nodes.withColumn("next", F.lead(F.struct("x", "y")).over(following)).where("next IS NOT NULL AND struct(x, y) <> next")
    low, high = F.least(F.struct("x", "y"), "next"), F.greatest(F.struct("x", "y"), "next")
    pieces = cut.select(key, *GRID, "part", "ring", low.alias("u"), high.alias("v")).select(
        key, *GRID, "part", "ring", F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy")
    )
    return pieces.groupBy(key, *GRID, "part", "ring", *_PIECE).agg(F.count(F.lit(1)).alias("times")).where("times % 2 = 1").drop("times")


def _border(pieces: DataFrame, key: str) -> DataFrame:
    """The pieces with the area on one side, directed to have it on their left: x1, y1 to x2, y2."""
    # A piece that is not level is met by a ray to the right, a level one by a ray upwards: the same with x and y swapped.
    turned = {"ux": "uy", "uy": "ux", "vx": "vy", "vy": "vx", "min_x": "min_y", "min_y": "min_x"}
    swapped = pieces.select(key, "part", "ring", "wide", *[F.col(other).alias(name) for name, other in turned.items()])

    def row(y: str):
        return F.floor((F.expr(y) - F.col("min_y")) / F.col("wide")).cast("int")

    def lined(df: DataFrame, axis: int) -> DataFrame:
        rows = F.explode(F.sequence(row("least(uy, vy)"), row("greatest(uy, vy)")))
        return df.select(key, F.lit(axis).alias("axis"), "part", "ring", rows.alias("row"), *[F.col(c).alias(f"r_{c}") for c in _PIECE])

    def middles(df: DataFrame, axis: int) -> DataFrame:
        one = df.select(key, "min_y", "wide", *_PIECE).distinct()
        return one.select(key, F.lit(axis).alias("axis"), row("(uy + vy) / 2").alias("row"), *_PIECE)

    tilted, level = middles(pieces.where("uy <> vy"), 0), middles(swapped.where("ux = vx"), 1)
    met = tilted.unionByName(level).join(lined(pieces, 0).unionByName(lined(swapped, 1)), [key, "axis", "row"])
    same = "(ux = r_ux AND uy = r_uy AND vx = r_vx AND vy = r_vy)"
    y = "((uy + vy) / 2)"
    crossed = f"NOT {same} AND ((r_uy > {y}) <> (r_vy > {y})) AND (ux + vx) / 2 < r_ux + try_divide((r_vx - r_ux) * ({y} - r_uy), r_vy - r_uy)"
    # The middle of a piece lies in one row: grouped with it, the rows of the join need no further shuffle.
    piece = [key, "axis", "row", *_PIECE]
    rings = met.groupBy(*piece, "part", "ring").agg(
        F.count_if(F.expr(crossed)).alias("far"), F.count_if(F.expr(same)).alias("own")
    )
    # Beyond the piece, seen along its ray, and before it: an outer ring met an odd number of times, no hole so.
    odd = {"beyond": F.col("far") % 2 == 1, "before": (F.col("far") + F.col("own")) % 2 == 1}
    parts = rings.groupBy(*piece, "part").agg(
        *[
            (F.coalesce(F.bool_or(F.when(F.col("ring") == 0, is_odd)), F.lit(False)) & ~F.coalesce(F.bool_or(F.when(F.col("ring") > 0, is_odd)), F.lit(False))).alias(side)
            for side, is_odd in odd.items()
        ]
    )
    sides = parts.groupBy(*piece).agg(F.bool_or("beyond").alias("beyond"), F.bool_or("before").alias("before")).where("beyond <> before")
    # Upwards the left side is before the piece; to the right (a level piece, swapped) it is beyond.
    upright = F.col("axis") == 0
    forward = (F.col("vy") > F.col("uy")) == F.when(upright, F.col("before")).otherwise(F.col("beyond"))
    both = sides.select(key, forward.alias("forward"), *[F.when(upright, F.col(c)).otherwise(F.col(turned[c])).alias(c) for c in _PIECE])
    ends = {"x1": ("ux", "vx"), "y1": ("uy", "vy"), "x2": ("vx", "ux"), "y2": ("vy", "uy")}
    return both.select(key, *[F.when(F.col("forward"), F.col(a)).otherwise(F.col(b)).alias(name) for name, (a, b) in ends.items()])


def _followed(border: DataFrame, at: list[str], clockwise: bool) -> DataFrame:
    """(id, to): the piece that follows each one, the next at its end clockwise (or the other way) from where it came."""
    out = border.select(*at, F.col("x1").alias("x"), F.col("y1").alias("y"), F.expr("atan2(y2 - y1, x2 - x1)").alias("angle"), F.col("id").alias("out"), F.lit(None).cast("long").alias("id"))
    back = border.select(*at, F.col("x2").alias("x"), F.col("y2").alias("y"), F.expr("atan2(y1 - y2, x1 - x2)").alias("angle"), F.lit(None).cast("long").alias("out"), "id")
    around = Window.partitionBy(*at, "x", "y").orderBy(F.col("angle") if clockwise else F.desc("angle"))
    before = F.last("out", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, -1))
    wrapped = F.last("out", ignorenulls=True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.unionByName(back).withColumn("to", F.coalesce(before, wrapped)).where("id IS NOT NULL").select("id", "to")


def _traced(followed: DataFrame, longest: int) -> DataFrame:
    """(id, ring, away): the least id of the ring that ``to`` leads round, and how many steps lead there.

    A round doubles how far each piece sees, so rings of n pieces take log2(n) joins. Each round is stored.
    """
    seen, span = followed.select("id", "to", F.col("id").alias("ring"), F.lit(0).cast("long").alias("away")), 1
    rounds = Rounds("traced")
    for _ in range(math.ceil(math.log2(max(longest, 2)))):
        seen = rounds.store(seen)
        ahead = seen.select(F.col("id").alias("to"), F.col("to").alias("onward"), F.col("ring").alias("other"), F.col("away").alias("beyond"))
        lower = F.col("other") < F.col("ring")
        seen = seen.join(ahead, "to").select(
            "id",
            F.col("onward").alias("to"),
            F.least("ring", "other").alias("ring"),
            F.when(lower, F.col("beyond") + span).otherwise(F.col("away")).alias("away"),
        )
        span *= 2
    return seen.select("id", "ring", "away")


def _rings(border: DataFrame, key: str) -> DataFrame:
    """(key, ring, points, area): closed rings that touch themselves nowhere; holes run clockwise, their area is negative."""
    numbered = stored(border.withColumn("id", F.monotonically_increasing_id()), "border")
    longest = numbered.groupBy(key).count().agg(F.max("count")).head()[0] or 0
    faces = _traced(_followed(numbered, [key], clockwise=True), longest).select("id", F.col("ring").alias("face"))
    faced = stored(numbered.join(faces, "id"), "faces")
    # Where a face's border comes back to a point, it goes the other way round there, which leaves simple rings.
    rings = _traced(_followed(faced, [key, "face"], clockwise=False), longest)
    order = F.when(F.col("away") == 0, F.lit(-(2**62))).otherwise(-F.col("away"))
    gathered = faced.join(rings, "id").groupBy(key, "ring").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("place"), "x1", "y1"))), lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))).alias("open")
    )
    closed = gathered.select(key, "ring", F.concat("open", F.slice("open", 1, 1)).alias("points"))
    return closed.withColumn("area", F.expr(geo._signed_area("points")))


def _parts(rings: DataFrame, key: str, geometry: str) -> DataFrame:
    """(key, geometry): outer rings with the holes whose smallest surrounding ring they are."""
    rings = stored(rings.withColumn("box", F.expr(geo._bounds("points"))), "rings")
    shells = rings.where("area > 0")
    # The middle of a hole's first edge lies on no other ring.
    holes = rings.where("area < 0").select(
        key,
        F.col("ring").alias("hole"),
        F.col("points").alias("hole_points"),
        F.expr("(points[0].x + points[1].x) / 2").alias("hx"),
        F.expr("(points[0].y + points[1].y) / 2").alias("hy"),
    )
    around = holes.join(shells, key).where("hx BETWEEN box.min_x AND box.max_x AND hy BETWEEN box.min_y AND box.max_y")
    around = around.where(F.expr(geo._odd_crossings("hx", "hy", geo._edges("points"))))
    owned = around.groupBy(key, "hole").agg(F.min_by("ring", F.struct("area", "ring")).alias("ring"), F.first("hole_points").alias("hole_points"))
    cut = owned.groupBy(key, "ring").agg(F.array_sort(F.collect_list("hole_points")).alias("holes"))
    empty = F.expr("array()").cast(rings.select(F.array("points").alias("a")).schema["a"].dataType)
    parts = shells.join(cut, [key, "ring"], "left").select(key, F.concat(F.array("points"), F.coalesce("holes", empty)).alias("part"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias(geometry))


def mended(df: DataFrame, checked: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """``df`` with the geometries that ``checked`` (a validity report) finds invalid drawn anew; stored bounds are worked out again.

    Geometries that are empty, hold coordinates that are not finite, or have no area are left as they are.
    """
    hopeless = ["Empty geometry", "Coordinates not finite"]
    bad = checked.where(~F.col("reason").isin(validity.VALID, *hopeless)).select(F.col(key).alias("_key"))
    rings = df.select(F.col(key).alias("_key"), F.col(geometry).alias("_rings")).join(bad, "_key", "left_semi")
    # Closed once: taken apart as it is worked out, each ring would be closed again for every filter on it.
    closed = stored(validity.repaired(rings, "_rings"), "closed")
    edges = stored(edges_of(closed, "_key", "_rings"), "edges")
    pieces = stored(_pieces(edges, "_key"), "pieces")
    drawn = _parts(_rings(_border(pieces, "_key"), "_key"), "_key", "_drawn")
    new = df.join(drawn, F.col(key) == F.col("_key"), "left").withColumn(geometry, F.coalesce("_drawn", geometry)).drop("_drawn", "_key")
    bounds = [c for c in ("min_x", "min_y", "max_x", "max_y") if c in df.columns]
    if bounds:
        new = new.withColumn("_box", geo.bounds(geometry)).withColumns({c: F.col(f"_box.{c}") for c in bounds}).drop("_box")
    return new.select(df.columns)
