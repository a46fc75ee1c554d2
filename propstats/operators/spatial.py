"""Polygon containment join: small areas within larger ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.sources.tables import stored

# A table is broadcast only up to this measured size; beyond it the join shuffles.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes that a row of the cell table and of the edge table takes in a broadcast, with room to spare.
_ROW_BYTES = 512
_WALL_BYTES = 128


def with_srid(df: DataFrame, default: int = 4326) -> DataFrame:
    """Add ``srid``, or fill it where a geometry has none."""
    given = F.col("srid") if "srid" in df.columns else F.lit(None).cast("int")
    return df.withColumn("srid", F.coalesce(given, F.lit(default)))


def require_same_srid(left: DataFrame, right: DataFrame) -> None:
    """Raise unless both layers use one and the same reference system."""
    found = (
        left.select("srid")
        .unionByName(right.select("srid"))
        .agg(F.min("srid").alias("low"), F.max("srid").alias("high"), F.count_if(F.col("srid").isNull()).alias("unset"))
        .head()
    )
    if found.low != found.high or found.unset:
        raise ValueError(f"layers differ in reference system: {found.low} to {found.high}, {found.unset} unset")


_BOUNDS = ["min_x", "min_y", "max_x", "max_y"]


def with_bounds(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Add ``min_x, min_y, max_x, max_y``; a stored layer that carries them keeps its own."""
    if set(_BOUNDS) <= set(df.columns):
        return df
    return df.withColumn("_box", geo.bounds(geometry)).select("*", "_box.*").drop("_box")


def extent(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row: the bounds of a whole layer and their centre."""
    return with_bounds(df, geometry).agg(
        F.min("min_x").alias("min_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"),
        F.max("max_y").alias("max_y"),
    ).withColumns(
        {
            "center_x": (F.col("min_x") + F.col("max_x")) / 2,
            "center_y": (F.col("min_y") + F.col("max_y")) / 2,
        }
    )


def _cells(low: str, high: str):
    size = F.pow(F.lit(2.0), F.col("_level"))
    # As tolerant as the comparison of boxes.
    first, last = (F.floor((F.col(c) + by) / size).cast("bigint") for c, by in ((low, -geo.TOLERANCE), (high, geo.TOLERANCE)))
    return F.sequence(first, last)


def container_cells(boxes: DataFrame) -> DataFrame:
    """Containers once for each cell (``_level``, ``_cx``, ``_cy``) they reach, on a grid as coarse as they are large.

    The cells of a container are at least as wide as it is: it reaches four at most, whatever the others' size.
    """
    side = F.greatest(F.col("_c_max_x") - F.col("_c_min_x"), F.col("_c_max_y") - F.col("_c_min_y")) + 4 * geo.TOLERANCE
    levelled = boxes.where(F.col("_c_min_x").isNotNull()).withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    return levelled.withColumn("_cx", F.explode(_cells("_c_min_x", "_c_max_x"))).withColumn(
        "_cy", F.explode(_cells("_c_min_y", "_c_max_y"))
    )


def _banded_edges(containers: DataFrame, geometry: str) -> DataFrame:
    """Edges (c, c_part, x1, y1, x2, y2, band) of containers, once for each band of heights they reach.

    A container has about as many bands as the root of its edges.
    """
    parts = containers.select("c", "origin", "step", F.posexplode(geometry).alias("c_part", "rings"))
    edges = parts.select("c", "origin", "step", "c_part", F.explode(F.expr(f"flatten(transform(rings, ring -> {geo.edges_of_distinct_points('ring')}))")).alias("e"))
    edges = edges.select("c", "origin", "step", "c_part", "e.*")
    return edges.withColumn("band", F.explode(_bands("least(y1, y2)", "greatest(y1, y2)"))).drop("origin", "step")


def _bands(low: str, high: str):
    first, last = (f"CAST(floor(({y} {by} {geo.TOLERANCE!r}D - origin) / step) AS INT)" for y, by in ((low, "-"), (high, "+")))
    return F.expr(f"sequence({first}, {last})")


_INNER = ["a", "c", "a_part"]


def _contained(pairs: DataFrame, small: DataFrame, containers: DataFrame, geometry: str, broadcast_bytes: int) -> DataFrame:
    """The ``pairs`` (a, c) whose area lies within its container, by their edges as rows.

    An edge of a small area is cut where edges of the container meet it; each piece is wholly in or out, so its middle tells.
    Edges meet only in the same band of heights of the same container, both for the cuts and for the middles.
    With all middles inside, only a hole of the container can be missing from it, and then one of its points lies in
    the area. The container's edges are stored once, and broadcast only if that table, as it is, is small enough.
    """
    wanted = containers.join(pairs.select("c").distinct(), "c", "left_semi")
    count = F.greatest(F.ceil(F.sqrt(geo.num_points(geometry).cast("double"))), F.lit(1))
    step = F.greatest((F.col("c_max_y") - F.col("c_min_y")) / count, F.lit(geo.TOLERANCE)).alias("step")
    shaped = wanted.select("c", geometry, F.col("c_min_y").alias("origin"), step)
    bands = stored(shaped.drop(geometry), "bands")
    walls = stored(_banded_edges(shaped, geometry), "walls")
    light = walls.count() * _WALL_BYTES <= broadcast_bytes
    beside = lambda df: F.broadcast(df) if light else df.hint("merge")

    outlines = small.join(pairs.select("a").distinct(), "a", "left_semi").select("a", F.posexplode(geometry).alias("a_part", "rings"))
    edges = outlines.select("a", "a_part", F.posexplode(F.expr(f"flatten(transform(rings, ring -> {geo.edges_of_distinct_points('ring')}))")).alias("at", "e"))
    edges = stored(edges.select("a", "a_part", "at", F.col("e.x1").alias("ax1"), F.col("e.y1").alias("ay1"), F.col("e.x2").alias("ax2"), F.col("e.y2").alias("ay2")), "outlines")
    sizes = edges.groupBy("a", "a_part").agg(F.count(F.lit(1)).alias("edges"))
    tried = pairs.join(beside(bands), "c").join(edges, "a")

    # Where walls cut an edge, as shares of its length, for each part of the container that has a wall near it.
    near = tried.withColumn("band", F.explode(_bands("least(ay1, ay2)", "greatest(ay1, ay2)"))).join(beside(walls), ["c", "band"])
    dx, dy, ox, oy, px, py = "(ax2 - ax1)", "(ay2 - ay1)", "(x2 - x1)", "(y2 - y1)", "(x1 - ax1)", "(y1 - ay1)"
    turn = f"({dx} * {oy} - {dy} * {ox})"
    share = F.expr(
        f"CASE WHEN try_divide({px} * {dy} - {py} * {dx}, {turn}) BETWEEN -1e-9D AND 1.000000001D THEN try_divide({px} * {oy} - {py} * {ox}, {turn}) END"
    )
    edge = [*_INNER, "c_part", "at", "ax1", "ay1", "ax2", "ay2", "origin", "step"]
    cut = near.groupBy(*edge).agg(F.collect_set(F.when((share > 0) & (share < 1), share)).alias("cuts"))
    places = F.expr("array_sort(concat(array(0D, 1D), cuts))")
    middles = F.expr("transform(slice(places, 1, size(places) - 1), (s, i) -> (s + places[i + 1]) / 2)")
    points = cut.withColumn("places", places).withColumn("m", F.explode(middles))
    points = points.select(*_INNER, "c_part", "at", "m", "origin", "step", F.expr("ax1 + (ax2 - ax1) * m").alias("x"), F.expr("ay1 + (ay2 - ay1) * m").alias("y"))
    # Parts cut into many pieces are dealt anew by piece.
    points = stored(points, "middles")
    met = points.withColumn("band", F.explode(_bands("y", "y"))).join(beside(walls), ["c", "c_part", "band"])
    on, spans = geo.on_edge("x", "y", "x1", "y1", "x2", "y2"), "(y1 > y) <> (y2 > y)"
    # A point near the border of two bands meets some walls twice: crossings are counted in its own band.
    own = "band = CAST(floor((y - origin) / step) AS INT)"
    crossed = F.expr(f"{own} AND {spans} AND x < x1 + try_divide((x2 - x1) * (y - y1), y2 - y1)")
    inside = met.groupBy(*_INNER, "c_part", "at", "m").agg(F.bool_or(F.expr(on)).alias("on_wall"), F.count_if(crossed).alias("crossed"))
    inside = inside.where("on_wall OR crossed % 2 = 1").groupBy(*_INNER, "c_part").agg(F.count(F.lit(1)).alias("inside"))
    all_pieces = points.groupBy(*_INNER, "c_part").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("at").alias("seen"))
    within = all_pieces.join(inside, [*_INNER, "c_part"]).join(sizes, ["a", "a_part"]).where("inside = pieces AND seen = edges")

    # Of these, parts around a hole of the container's part.
    holes = wanted.select("c", F.posexplode(geometry).alias("c_part", "rings")).where("size(rings) > 1")
    holes = holes.select("c", "c_part", F.explode(F.expr(f"transform(slice(rings, 2, size(rings) - 1), ring -> {geo.ring_inner_point('ring')})")).alias("h"))
    holes = holes.select("c", "c_part", F.col("h.x").alias("x"), F.col("h.y").alias("y"))
    fits = stored(within.select(*_INNER, "c_part"), "fits")
    boxes = edges.groupBy("a", "a_part").agg(*[f(f"a{c}{i}").alias(f"{n}_{c}") for c in "xy" for f, n, i in ((F.min, "low", 1), (F.max, "high", 1))])
    around = fits.join(boxes, ["a", "a_part"]).join(holes, ["c", "c_part"]).where("x BETWEEN low_x AND high_x AND y BETWEEN low_y AND high_y")
    by_edge = around.join(edges, ["a", "a_part"]).groupBy(*_INNER, "c_part", "x", "y").agg(
        F.count_if(F.expr("(ay1 > y) <> (ay2 > y) AND x < ax1 + try_divide((ax2 - ax1) * (y - ay1), ay2 - ay1)")).alias("crossed"),
        F.bool_or(F.expr(geo.on_edge("x", "y", "ax1", "ay1", "ax2", "ay2"))).alias("on_edge"),
    )
    swallowed = by_edge.where("crossed % 2 = 1 AND NOT on_edge").select(*_INNER, "c_part").distinct()
    fits = fits.join(swallowed, [*_INNER, "c_part"], "left_anti").select(*_INNER).distinct()
    # Every part of the area has to lie in some part of the container.
    parts = sizes.groupBy("a").agg(F.count(F.lit(1)).alias("parts"))
    return fits.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")).join(parts, "a").where("n = parts").select("a", "c")


def within_join(
    small: DataFrame,
    containers: DataFrame,
    container_columns: Sequence[str],
    how: str = "inner",
    geometry: str = "geometry",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join every row of ``small`` to the containers it lies within; touching their border is allowed.

    Each container is keyed by the cells its box reaches on a grid of its own size, four at most. A small
    area is looked up by its lower left corner on each grid in use, so a pair meets in exactly one cell. In
    a cell only boxes are compared, and polygons stay where they are. What is left is tested exactly by joins over edges
    (``_contained``), and not at all for containers that are plain rectangles. Containers are stored once, numbered;
    so is ``small`` where rows have to be found again: for the exact test, and for ``how='left'``, which keeps
    small areas that fit nowhere.

    Layers that name their reference system must name the same one.

    Tables are broadcast by their own measured size: the cells of the containers' boxes, and the edges by bands. Larger
    ones shuffle on the cell or the band, and adaptive execution splits those that turn out hot.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join kind: {how}")
    if "srid" in small.columns and "srid" in containers.columns:
        require_same_srid(small, containers)
    named = {c: f"_c_{c}" for c in container_columns}
    layer = with_bounds(containers, geometry).select(
        *[F.col(c).alias(name) for c, name in named.items()], F.col(geometry).alias("_shape"), geo.is_box(geometry).alias("_is_box"), *[F.col(c).alias(f"_c_{c}") for c in _BOUNDS]
    )
    layer = stored(layer.withColumn("_c", F.monotonically_increasing_id()), "containers")
    keyed = container_cells(layer.drop("_shape"))
    found = keyed.agg(
        F.count(F.lit(1)).alias("cells"), F.collect_set("_level").alias("levels"), F.coalesce(F.bool_and("_is_box"), F.lit(True)).alias("boxes")
    ).head()
    only_boxes = found.boxes
    rows = small
    if how == "left" or not only_boxes:
        rows = stored(small.withColumn("_a", F.monotonically_increasing_id()), "small")
    # A level for each factor of two between the sizes of containers: a few dozen at the very most.
    levels = F.array(*[F.lit(level) for level in sorted(found.levels)]).cast("array<int>")
    located = with_bounds(rows, geometry).withColumn("_level", F.explode(levels)).withColumns(
        {
            "_cx": F.floor(F.col("min_x") / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint"),
            "_cy": F.floor(F.col("min_y") / F.pow(F.lit(2.0), F.col("_level"))).cast("bigint"),
        }
    )
    condition = (
        (F.col("min_x") >= F.col("_c_min_x") - geo.TOLERANCE)
        & (F.col("min_y") >= F.col("_c_min_y") - geo.TOLERANCE)
        & (F.col("max_x") <= F.col("_c_max_x") + geo.TOLERANCE)
        & (F.col("max_y") <= F.col("_c_max_y") + geo.TOLERANCE)
    )
    right = F.broadcast(keyed) if found.cells * _ROW_BYTES <= broadcast_bytes else keyed.hint("merge")
    outcome = [F.col(name).alias(c) for c, name in named.items()]
    if rows is small:
        return located.join(right, ["_level", "_cx", "_cy"]).where(condition).select(*small.columns, *outcome)
    boxed = located.select("_a", *_BOUNDS, "_level", "_cx", "_cy")
    candidates = boxed.join(right, ["_level", "_cx", "_cy"]).where(condition).select("_a", "_c", "_is_box")
    if only_boxes:
        pairs = candidates.select("_a", "_c")
    else:
        candidates = stored(candidates, "candidates")
        shapes = candidates.where("NOT _is_box").select(F.col("_a").alias("a"), F.col("_c").alias("c"))
        walls = layer.where("NOT _is_box").select(F.col("_c").alias("c"), F.col("_shape").alias("shape"), F.col("_c_min_y").alias("c_min_y"), F.col("_c_max_y").alias("c_max_y"))
        areas = rows.select(F.col("_a").alias("a"), F.col(geometry).alias("shape"))
        exact = _contained(shapes, areas, walls, "shape", broadcast_bytes).toDF("_a", "_c")
        pairs = stored(candidates.where("_is_box").select("_a", "_c").unionByName(exact), "pairs")
    names = layer.select("_c", *named.values())
    matched = pairs.join(F.broadcast(names) if found.cells * _ROW_BYTES <= broadcast_bytes else names.hint("merge"), "_c").drop("_c")
    sized = matched if broadcast_bytes else matched.hint("merge")
    return rows.join(sized, "_a", how).select(*small.columns, *outcome)
