"""Polygon validity as a report over a whole layer, repair, and what to keep apart.

Rings are taken apart into edges, and edges into the cells of a grid that each geometry gets by its
own size and number of edges. Only edges that share a cell are compared, so a ring of thousands
of points costs about as many comparisons, and the work of one geometry spreads over tasks.

Rings of one part may touch in points. Rings and the points where they touch form a graph; a cycle in it
is a closed line of boundary, which cuts the part's interior in two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.operators.spatial import with_bounds
from propstats.sources.tables import Rounds, stored

VALID = "Valid"
# In the order in which they are reported; the first that applies is a geometry's reason.
REASONS = [
    "Empty geometry",
    "Coordinates not finite",
    "Too few points",
    "Ring not closed",
    "Zero area",
    "Self-intersection",
    "Rings cross",
    "Hole lies outside shell",
    "Nested holes",
    "Overlapping parts",
    "Interior is disconnected",
]
_BOX = ["min_x", "min_y", "max_x", "max_y"]
GRID = ["min_x", "min_y", "cell", "wide"]
#: Up to how many cells a side the edges of a geometry are compared in one cell: 16 points, 120 pairs.
FEW_ACROSS = 4


def _reason(name: str) -> Column:
    return F.lit(REASONS.index(name))


def edges_of(df: DataFrame, key: str, geometry: str) -> DataFrame:
    """Every edge with its part, ring, place in the ring, the ring's edges, its geometry's grid, and whether that has several rings.

    ``cell`` is the grid that has about as many cells as the geometry has edges; ``wide`` the one in which edges are compared: the same,
    but one cell for all where there are few edges, as comparing them all then costs less than a row per edge and cell.
    """
    boxed = with_bounds(df.select(key, geometry, *[c for c in _BOX if c in df.columns]), geometry)
    across = F.ceil(F.sqrt(F.greatest(geo.num_points(geometry), F.lit(1)).cast("double")))
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    cell = F.when(side > 0, side / across).otherwise(F.lit(1.0))
    wide = F.when(across <= FEW_ACROSS, F.col("cell") * (across + 1)).otherwise(F.col("cell"))
    boxed = boxed.withColumn("cell", cell).select(
        key, geometry, "min_x", "min_y", "cell", wide.alias("wide"), (F.size(F.flatten(geometry)) > 1).alias("several")
    )
    rings = boxed.select(key, *GRID, "several", F.posexplode(geometry).alias("part", "rings"))
    rings = rings.select("*", F.posexplode("rings").alias("ring", "points")).drop("rings")
    # Taken apart as an expression: of a column, the filter for empty arrays would work the edges out again.
    edges = F.posexplode(F.expr(geo.numbered_edges("points"))).alias("at", "e")
    return rings.select(key, *GRID, "several", "part", "ring", edges).select(key, *GRID, "several", "part", "ring", "at", "e.*")


def _row(y: str | Column) -> Column:
    return F.floor(((F.col(y) if isinstance(y, str) else y) - F.col("min_y")) / F.col("wide")).cast("int")


def _column(x: str | Column) -> Column:
    return F.floor(((F.col(x) if isinstance(x, str) else x) - F.col("min_x")) / F.col("wide")).cast("int")


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    return f"signum(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def edge_pairs(edges: DataFrame, key: str) -> DataFrame:
    """Every two edges of a geometry that share a cell and whose boxes meet, once for each such cell, as ``a_`` and ``b_`` columns.

    ``proper`` says whether they cross, ``overlap`` whether they share a line, ``t1`` to ``t4`` which of their ends lies on
    the other one (see ``TOUCHES``). Use the same columns of a and b, then both sides of the join are one shuffle.
    """
    low_x, high_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    low_y, high_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    celled = edges.withColumn("cx", F.explode(F.sequence(_column(low_x), _column(high_x)))).withColumn(
        "cy", F.explode(F.sequence(_row(low_y), _row(high_y)))
    )
    names = [c for c in celled.columns if c not in (key, "cx", "cy")]
    left, right = (celled.select(key, "cx", "cy", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    first = "(a_part < b_part OR a_part = b_part AND (a_ring < b_ring OR a_ring = b_ring AND a_at < b_at))"
    boxes = " AND ".join(
        f"greatest({p}_{c}1, {p}_{c}2) >= least({q}_{c}1, {q}_{c}2)" for c in "xy" for p, q in ("ab", "ba")
    )
    pairs = left.join(right, [key, "cx", "cy"]).where(f"{first} AND {boxes}")
    a, b = ("a_x1", "a_y1", "a_x2", "a_y2"), ("b_x1", "b_y1", "b_x2", "b_y2")
    # On which side of a the ends of b lie, and of b those of a.
    sides = {"s1": _side(*a, *b[:2]), "s2": _side(*a, *b[2:]), "s3": _side(*b, *a[:2]), "s4": _side(*b, *a[2:])}
    # How far two edges on one line overlap, by their longer direction.
    overlap = "s1 = 0 AND s2 = 0 AND (" + " OR ".join(
        f"least(greatest(a_{c}1, a_{c}2), greatest(b_{c}1, b_{c}2)) > greatest(least(a_{c}1, a_{c}2), least(b_{c}1, b_{c}2))"
        for c in "xy"
    ) + ")"
    tests = {
        "proper": "s1 * s2 < 0 AND s3 * s4 < 0",
        "overlap": overlap,
        "t1": _on("s1", "b", "a", 1),
        "t2": _on("s2", "b", "a", 2),
        "t3": _on("s3", "a", "b", 1),
        "t4": _on("s4", "a", "b", 2),
    }
    return _worked_out(_worked_out(pairs, sides), tests)


def _worked_out(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """Add columns that later filters use by value.

    A filter on plain columns goes below them, with their expressions in place of each use: in the condition of the join of edges that
    makes a method too long for the JVM to compile. Filters stay above a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[F.expr(text).alias(name) for name, text in named.items()]))))


def _on(side: str, p: str, e: str, end: int) -> str:
    x, y = f"{p}_x{end}", f"{p}_y{end}"
    return f"{side} = 0 AND {x} BETWEEN least({e}_x1, {e}_x2) AND greatest({e}_x1, {e}_x2) AND {y} BETWEEN least({e}_y1, {e}_y2) AND greatest({e}_y1, {e}_y2)"


#: The end of one edge that lies on the other where this holds.
TOUCHES = {"t1": ("b_x1", "b_y1"), "t2": ("b_x2", "b_y2"), "t3": ("a_x1", "a_y1"), "t4": ("a_x2", "a_y2")}


def _meetings(edges: DataFrame, key: str) -> DataFrame:
    """(key, code) for each kind of forbidden meeting of two edges, (key, part, rings, touches) where rings of a part touch.

    ``touches`` has a place per end of the two edges, null where that end touches nothing.
    """
    touch = f"({' OR '.join(TOUCHES)})"
    neighbours = "(b_at - a_at = 1 OR b_at - a_at = least(a_n, b_n) - 1)"
    one_ring = "(a_part = b_part AND a_ring = b_ring)"
    code = F.expr(
        f"CASE WHEN {one_ring} AND (proper OR overlap OR (NOT {neighbours} AND {touch})) THEN {REASONS.index('Self-intersection')} "
        f"WHEN NOT {one_ring} AND a_part = b_part AND (proper OR overlap) THEN {REASONS.index('Rings cross')} "
        f"WHEN a_part <> b_part AND (proper OR overlap) THEN {REASONS.index('Overlapping parts')} END"
    )
    ends = ", ".join(f"CASE WHEN {test} THEN named_struct('x', {x}, 'y', {y}) END" for test, (x, y) in TOUCHES.items())
    met = F.expr(f"CASE WHEN a_part = b_part AND a_ring <> b_ring AND {touch} THEN array({ends}) END")
    # Those with a code or touches.
    return (
        edge_pairs(edges, key)
        .where(f"a_part = b_part AND (a_ring <> b_ring OR NOT {neighbours}) AND {touch} OR proper OR overlap")
        .select(key, code.alias("code"), F.col("a_part").alias("part"), F.array("a_ring", "b_ring").alias("rings"), met.alias("touches"))
    )


def _cut_off(met: DataFrame, key: str) -> DataFrame:
    """(key, code) for parts whose interior falls apart: rings and the points where they touch have a cycle.

    Such a graph has one exactly if it has more lines than nodes less components. Components come from the
    least ring that a ring reaches, in stored rounds that also look up the label of the label.
    """
    part = [key, "part"]
    touched = met.select(*part, "rings", F.explode("touches").alias("t")).where("t IS NOT NULL")
    lines = stored(touched.select(*part, F.explode("rings").alias("ring"), "t.x", "t.y").distinct(), "touching")
    labels, last, rounds = lines.select(*part, "ring", F.col("ring").alias("label")).distinct(), None, Rounds("labels")
    while True:
        labels = rounds.store(labels)
        total = labels.agg(F.sum("label")).head()[0]
        if total == last:
            break
        last = total
        by_point = lines.join(labels, [*part, "ring"]).groupBy(*part, "x", "y").agg(F.min("label").alias("label"))
        reached = lines.join(by_point, [*part, "x", "y"]).groupBy(*part, "ring").agg(F.min("label").alias("label"))
        further = labels.select(*part, F.col("ring").alias("label"), F.col("label").alias("further"))
        labels = reached.join(further, [*part, "label"]).select(*part, "ring", F.least("label", "further").alias("label"))
    rings = labels.groupBy(*part).agg(F.count(F.lit(1)).alias("rings"), F.count_distinct("label").alias("components"))
    points = lines.groupBy(*part).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("x", "y").alias("points"))
    cyclic = rings.join(points, part).where("lines > rings + points - components")
    return cyclic.select(key, _reason("Interior is disconnected").alias("code"))


def _misplaced(edges: DataFrame, key: str) -> DataFrame:
    """(key, code) for vertices on the wrong side of another ring of their geometry.

    A vertex meets the edges that cross its row of cells, and the crossings to its right are counted.
    """
    edges = edges.where("several")
    vertices = edges.select(key, F.col("part").alias("v_part"), F.col("ring").alias("v_ring"), F.col("x1").alias("x"), F.col("y1").alias("y"), _row("y1").alias("row"))
    rows = F.explode(F.sequence(_row(F.least("y1", "y2")), _row(F.greatest("y1", "y2"))))
    lined = edges.select(key, "part", "ring", "x1", "y1", "x2", "y2", rows.alias("row"))
    # Every vertex of a hole also meets an edge of its shell that is nowhere: in a row that no edge of the shell reaches it is outside it.
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    holes = vertices.where("v_ring > 0").select(key, F.col("v_part").alias("part"), F.lit(0).alias("ring"), *nowhere, "row").distinct()
    met = vertices.join(lined.unionByName(holes), [key, "row"]).where("v_part <> part OR (v_ring > 0 AND v_ring <> ring)")
    right = "((y1 > y) <> (y2 > y)) AND x < x1 + try_divide((x2 - x1) * (y - y1), y2 - y1)"
    on = f"{_side('x1', 'y1', 'x2', 'y2', 'x', 'y')} = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)"
    # Against another part all its rings count together (a hole of it is outside); within a part each ring counts alone.
    target = F.when(F.col("part") == F.col("v_part"), F.col("ring")).otherwise(-1)
    # A vertex has one row: grouped with it, the rows of the join need no further shuffle.
    placed = met.groupBy(key, "row", "v_part", "v_ring", "x", "y", "part", target.alias("target")).agg(
        F.count_if(F.expr(right)).alias("crossed"), F.coalesce(F.bool_or(F.expr(on)), F.lit(False)).alias("on_it")
    )
    inside = (F.col("crossed") % 2 == 1) & ~F.col("on_it")
    code = (
        F.when((F.col("target") == -1) & inside, _reason("Overlapping parts"))
        .when((F.col("target") > 0) & inside, _reason("Nested holes"))
        .when((F.col("target") == 0) & ~inside & ~F.col("on_it"), _reason("Hole lies outside shell"))
    )
    return placed.select(key, code.alias("code")).where("code IS NOT NULL")


def report(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """One row per geometry: ``key``, ``reason`` (``Valid`` or the first problem) and ``repeated_points``, a note.

    ``key`` tells geometries apart. Points that repeat their neighbour are no fault. A coordinate that is null, NaN,
    infinite or beyond 1e100 has a reason of its own; such a geometry's edges are not compared. The edges are
    stored once and compared from there.
    """
    own = F.expr(geo.ring_problem_code("_rings", {name: i for i, name in enumerate(REASONS)}))
    # Dealt by key: a layer may lie in few files, and the report is joined by key in the end.
    shapes = df.select(F.col(key).alias("_key"), F.col(geometry).alias("_rings")).repartition("_key")
    simple = shapes.select("_key", own.alias("code"), F.expr(geo.repeated_points_count("_rings")).alias("repeated_points"))
    edges = stored(edges_of(shapes.where(F.expr(geo.all_finite("_rings"))), "_key", "_rings"), "edges")
    pairs = stored(_meetings(edges, "_key"), "meetings")
    found = pairs.where("code IS NOT NULL").select("_key", "code")
    met = found.unionByName(_misplaced(edges, "_key")).unionByName(_cut_off(pairs, "_key"))
    met = met.groupBy("_key").agg(F.min("code").alias("met_code"))
    names = F.array(*[F.lit(name) for name in REASONS])
    worst = F.least("code", "met_code")
    return simple.join(met, "_key", "left").select(
        F.col("_key").alias(key), F.when(worst.isNull(), F.lit(VALID)).otherwise(F.get(names, worst)).alias("reason"), "repeated_points"
    )


def repaired(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Close rings, drop repeated points, turn rings the usual way round. Bounds that are stored stay right."""
    return df.withColumn(geometry, geo.repair(geometry))


def split(df: DataFrame, checked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their reason."""
    joined = df.join(checked.select(key, "reason"), key)
    return joined.where(F.col("reason") == VALID).drop("reason"), joined.where(F.col("reason") != VALID)
