"""Shared areas of two polygon layers, and counts apportioned by them.

A polygon is the signed sum of the strips below its edges: those under its upper edges less those under
its lower ones. So the area two polygons share is the signed sum, over all pairs of their edges, of what two
strips share, the integral of the lower of two lines over the x that both edges span. Holes and several
parts need no case of their own.

Pairs of polygons come from a grid as coarse as the larger of the two. The container's edges are cut by
upright slabs, about the root of their number, and joined to the cut edges of the small areas beside it by (container, slab):
an edge meets only those above or below it, every piece meets once, and the work of a container
that many areas overlap spreads over its slabs. Edges, not polygons, travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.functions import geometry as geo
from propstats.operators.spatial import require_same_srid, with_bounds
from propstats.sources.tables import stored

#: Polygons that share no more than this part of the smaller one only touch.
LEAST_SHARE = 1e-9
_BOX = ["min_x", "min_y", "max_x", "max_y"]


def _celled(boxes: DataFrame, levels: list[int], name: str) -> DataFrame:
    """Boxes with the cells they reach on the grid of their own size and on every coarser one in use, four at most on each."""
    grids = boxes.withColumn("grid", F.explode(F.filter(F.array(*[F.lit(g) for g in levels]).cast("array<int>"), lambda g: g >= F.col("level"))))

    def cells(low: str, high: str) -> Column:
        size = F.pow(F.lit(2.0), F.col("grid"))
        return F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long"))

    celled = grids.withColumn("cx", F.explode(cells("min_x", "max_x"))).withColumn("cy", F.explode(cells("min_y", "max_y")))
    own = (F.col("grid") == F.col("level")).alias(f"{name}_own")
    return celled.select("grid", "cx", "cy", own, F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _BOX])


def _boxes(df: DataFrame) -> DataFrame:
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(0)).cast("int")
    return df.where(F.col("min_x").isNotNull()).select("id", *_BOX, level.alias("level"))


def _pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b, low): areas and containers whose boxes overlap, and the height below which they share nothing."""
    a, b = _boxes(small), _boxes(large)
    # One grid for each factor of two between sizes: a few dozen at the very most.
    levels = sorted(r.level for r in a.select("level").union(b.select("level")).distinct().collect())
    met = _celled(a, levels, "a").join(_celled(b, levels, "b"), ["grid", "cx", "cy"]).where("a_own OR b_own")
    over = " AND ".join(f"a_min_{c} < b_max_{c} AND b_min_{c} < a_max_{c}" for c in "xy")
    # Of the cells where two meet, the one with the lower left corner of what their boxes share.
    first = " AND ".join(f"c{c} = floor(greatest(a_min_{c}, b_min_{c}) / pow(2D, grid))" for c in "xy")
    return met.where(f"{over} AND {first}").select("a", "b", F.greatest("a_min_y", "b_min_y").alias("low"))


def _edges(df: DataFrame, name: str) -> DataFrame:
    """Edges that are not upright, from left to right, with the sign of the strip below: upper ones 1, lower ones -1."""
    turned = df.withColumn("g", geo.repair("geometry")).select("id", F.explode(F.flatten("g")).alias("ring"))
    edges = turned.select(F.col("id").alias(name), F.explode(F.expr(geo.edges_of_distinct_points("ring"))).alias("e")).select(name, "e.*").where("x1 <> x2")
    sign = F.when(F.col("x1") > F.col("x2"), 1).otherwise(-1)
    back = F.col("x1") > F.col("x2")
    ends = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return edges.select(name, sign.alias("sign"), *[F.when(back, F.col(other)).otherwise(F.col(c)).alias(c) for c, other in ends.items()])


def _below(high1: str, high2: str, width: str) -> str:
    """The integral of the positive part of a line from ``high1`` to ``high2``."""
    return (
        f"CASE WHEN {high1} >= 0 AND {high2} >= 0 THEN {width} * ({high1} + {high2}) / 2 WHEN {high1} <= 0 AND {high2} <= 0 THEN 0D "
        f"ELSE {width} * greatest({high1}, {high2}) * greatest({high1}, {high2}) / (2 * abs({high1} - {high2})) END"
    )


def shared_areas(small: DataFrame, large: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(a, b, shared_area) for stored layers with a column ``id``: every two polygons that share some area."""
    left, right = (with_bounds(df.select("id", F.col(geometry).alias("geometry"), *[c for c in _BOX if c in df.columns])) for df in (small, large))
    pairs = stored(_pairs(left, right), "pairs")
    # Slabs of equal width: as many as the root of the container's edges, so that each holds about that many.
    count = F.greatest(F.ceil(F.sqrt(geo.num_points("geometry").cast("double"))), F.lit(1))
    width = (F.col("max_x") - F.col("min_x")) / count
    slabs = right.where("max_x > min_x").select(F.col("id").alias("b"), F.col("min_x").alias("origin"), width.alias("width"), F.col("max_x").alias("limit"))
    slabs = slabs.join(pairs.select("b").distinct(), "b", "left_semi")

    def cut(edges: DataFrame) -> DataFrame:
        """Edges within the container's span, in one piece for each slab."""
        first, last = "floor((greatest(x1, origin) - origin) / width)", "floor((least(x2, limit) - origin) / width)"
        inside = edges.where("x2 > origin AND x1 < limit").withColumn("slab", F.explode(F.expr(f"sequence(CAST({first} AS INT), CAST({last} AS INT))")))
        from_x, to_x = "greatest(x1, origin + slab * width)", "least(x2, least(origin + (slab + 1) * width, limit))"
        pieces = inside.withColumns({"p": F.expr(from_x), "q": F.expr(to_x)}).where("p < q")
        return pieces.withColumn("slope", F.expr("(y2 - y1) / (x2 - x1)"))

    ours = cut(_edges(left, "a").join(pairs, "a").join(slabs, "b")).select(
        "a", "b", "slab", "low", "sign", "p", "q", "slope", F.col("x1").alias("x"), F.col("y1").alias("y")
    )
    theirs = cut(_edges(right, "b").join(slabs, "b")).select(
        "b", "slab", *[F.col(c).alias(f"b_{name}") for c, name in (("sign", "sign"), ("p", "p"), ("q", "q"), ("slope", "slope"), ("x1", "x"), ("y1", "y"))]
    )
    met = ours.join(theirs, ["b", "slab"]).withColumns({"s": F.greatest("p", "b_p"), "t": F.least("q", "b_q")}).where("s < t")
    for at in "st":
        met = met.withColumn(f"a_{at}", F.expr(f"y + slope * ({at} - x) - low")).withColumn(f"b_{at}", F.expr(f"b_y + b_slope * ({at} - b_x) - low"))
    # Where the two lines cross, the lower one changes.
    cross = "(a_s - b_s) * (a_t - b_t) < 0"
    met = met.withColumn("part", F.expr(f"CASE WHEN {cross} THEN abs(a_s - b_s) / (abs(a_s - b_s) + abs(a_t - b_t)) END"))
    met = met.withColumn("middle", F.expr("a_s + part * (a_t - a_s)"))
    low_s, low_t = "least(a_s, b_s)", "least(a_t, b_t)"
    strip = F.expr(
        f"CASE WHEN part IS NULL THEN {_below(low_s, low_t, '(t - s)')} "
        f"ELSE {_below(low_s, 'middle', '(part * (t - s))')} + {_below('middle', low_t, '((1 - part) * (t - s))')} END"
    )
    return met.groupBy("a", "b").agg(F.sum(F.col("sign") * F.col("b_sign") * strip).alias("shared_area"))


def with_shares(
    small: DataFrame, containers: DataFrame, container_columns: Sequence[str], how: str = "inner", geometry: str = "geometry"
) -> DataFrame:
    """Each small area with every container it shares area with, the ``shared_area``, and its ``share`` of the small area.

    The shares of an area add up to one where containers tile it. Containers that it merely touches do not
    count. ``how='left'`` keeps areas that share nothing with any. Both layers are stored once, numbered.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join kind: {how}")
    if "srid" in small.columns and "srid" in containers.columns:
        require_same_srid(small, containers)
    areas = stored(small.withColumns({"_a": F.monotonically_increasing_id(), "_area": geo.area(geometry)}), "areas")
    others = stored(containers.withColumn("_b", F.monotonically_increasing_id()), "containers")
    layers = [df.select(F.col(row).alias("id"), geometry, *[c for c in _BOX if c in df.columns]) for df, row in ((areas, "_a"), (others, "_b"))]
    named = others.select("_b", *[F.col(c).alias(f"_c_{c}") for c in container_columns])
    shared = shared_areas(*layers, geometry).withColumnsRenamed({"a": "_a", "b": "_b"}).join(areas.select("_a", "_area"), "_a")
    shared = shared.withColumn("share", F.try_divide("shared_area", "_area")).where(F.col("share") > LEAST_SHARE).drop("_area")
    joined = areas.join(shared.join(named, "_b").withColumnsRenamed({"shared_area": "_shared", "share": "_share"}), "_a", how)
    outcome = [F.col(f"_c_{c}").alias(c) for c in container_columns]
    return joined.select(*small.columns, *outcome, F.col("_shared").alias("shared_area"), F.col("_share").alias("share"))


def apportioned(shares: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Per container, the counts of its small areas by their share of area; null counts add nothing."""
    return shares.groupBy(key).agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in counts])
