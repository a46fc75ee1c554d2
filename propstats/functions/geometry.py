"""Polygons as nested arrays, and their measures and predicates as native expressions.

A geometry is an array of parts, a part an array of closed rings (the outer one first, then the
holes), a ring an array of points ``struct<x, y>``. Coordinates are planar; measure and compare in
a metric grid and reproject only for output.

Public functions take column names and return columns. They are composed as Spark SQL text, which
the session parses at once; building the same nested lambdas call by call costs the driver
seconds per query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far, in layer units, a point may lie off a boundary and still count as on it.
TOLERANCE = 1e-7


# --- construction --------------------------------------------------------------------------


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*corners: tuple[Column, Column]) -> Column:
    """A ring through the corners, closed by repeating the first one."""
    return F.array(*[point(x, y) for x, y in [*corners, corners[0]]])


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An axis-aligned rectangle."""
    return F.array(F.array(box_ring(x0, y0, x1, y1)))


# --- building blocks, as SQL text ----------------------------------------------------------


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for the value, worked out once however often it is used."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _pairs(points: str, p: str, q: str, body: str) -> str:
    """``body`` for every two neighbours ``p`` and ``q`` of an array of points."""
    count = f"greatest(size({points}) - 1, 0)"
    return f"zip_with(slice({points}, 1, {count}), slice({points}, 2, {count}), ({p}, {q}) -> {body})"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0D, (total, term) -> total + term)"


def _signed_area(points: str) -> str:
    """Shoelace rule from the first point, which keeps the products small; positive counter-clockwise."""
    ox, oy = f"{points}[0].x", f"{points}[0].y"
    term = f"(a1.x - {ox}) * (a2.y - {oy}) - (a2.x - {ox}) * (a1.y - {oy})"
    return f"({_sum(_pairs(points, 'a1', 'a2', term))} / 2)"


def _area(geometry: str) -> str:
    ring_areas = f"transform(part, ring -> abs({_signed_area('ring')}))"
    part_area = _let(ring_areas, "areas", f"get(areas, 0) * 2 - {_sum('areas')}")
    return _sum(f"transform({geometry}, part -> {part_area})")


def _bounds(points: str) -> str:
    x, y = f"transform({points}, b -> b.x)", f"transform({points}, b -> b.y)"
    return (
        f"named_struct('min_x', array_min({x}), 'min_y', array_min({y}), "
        f"'max_x', array_max({x}), 'max_y', array_max({y}))"
    )


def _geometry_bounds(geometry: str) -> str:
    return _let(f"flatten(flatten({geometry}))", "corners", _bounds("corners"))


def _edges(points: str) -> str:
    return _pairs(points, "e1", "e2", "named_struct('x1', e1.x, 'y1', e1.y, 'x2', e2.x, 'y2', e2.y)")


def _x_at(edge: str, y: str) -> str:
    """Where the line of an edge that is not horizontal meets height ``y``."""
    return f"({edge}.x1 + try_divide(({edge}.x2 - {edge}.x1) * ({y} - {edge}.y1), {edge}.y2 - {edge}.y1))"


def _spans(edge: str, y: str) -> str:
    return f"(({edge}.y1 > {y}) != ({edge}.y2 > {y}))"


def _ring_inner_point(points: str) -> str:
    """A point strictly inside a simple ring, also a concave one.

    On a level halfway between the two lowest heights of its vertices, the interior lies between
    the first and the second crossing.
    """
    heights = f"array_sort(array_distinct(transform({points}, h -> h.y)))"
    level = _let(heights, "hs", "(get(hs, 0) + get(hs, 1)) / 2")
    crossed = f"filter({_edges(points)}, c -> {_spans('c', 'lv')})"
    xs = f"array_sort(transform({crossed}, c -> {_x_at('c', 'lv')}))"
    middle = _let(xs, "cx", "named_struct('x', (get(cx, 0) + get(cx, 1)) / 2, 'y', lv)")
    return _let(level, "lv", middle)


def _on_edge_of(x: str, y: str, ends: tuple[str, str, str, str], tolerance: float) -> str:
    """Distance to the edge's line, and place along it, both within the tolerance."""
    x1, y1, x2, y2 = ends
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    px, py = f"({x} - {x1})", f"({y} - {y1})"
    length2 = f"({dx} * {dx} + {dy} * {dy})"
    slack = f"(sqrt({length2}) * {tolerance!r}D)"
    along = f"({dx} * {px} + {dy} * {py})"
    return f"(abs({dx} * {py} - {dy} * {px}) <= {slack} AND {along} BETWEEN -{slack} AND {length2} + {slack})"


def _on_edge(x: str, y: str, edge: str, tolerance: float) -> str:
    return _on_edge_of(x, y, (f"{edge}.x1", f"{edge}.y1", f"{edge}.x2", f"{edge}.y2"), tolerance)


def _on_boundary(x: str, y: str, edges: str, tolerance: float) -> str:
    return f"exists({edges}, n -> {_on_edge(x, y, 'n', tolerance)})"


def _odd_crossings(x: str, y: str, edges: str) -> str:
    return f"(size(filter({edges}, n -> {_spans('n', y)} AND {x} < {_x_at('n', y)})) % 2 = 1)"


def _cuts(edge: str, others: str) -> str:
    """Where other edges meet an edge, as shares of its length, sorted, with both ends.

    A cut too many does no harm, so ends of other edges count with some slack.
    """
    near = (
        f"filter({others}, o -> greatest(o.x1, o.x2) >= least({edge}.x1, {edge}.x2) "
        f"AND least(o.x1, o.x2) <= greatest({edge}.x1, {edge}.x2) "
        f"AND greatest(o.y1, o.y2) >= least({edge}.y1, {edge}.y2) "
        f"AND least(o.y1, o.y2) <= greatest({edge}.y1, {edge}.y2))"
    )
    dx, dy = f"({edge}.x2 - {edge}.x1)", f"({edge}.y2 - {edge}.y1)"
    ox, oy = "(o.x2 - o.x1)", "(o.y2 - o.y1)"
    px, py = f"(o.x1 - {edge}.x1)", f"(o.y1 - {edge}.y1)"
    turn = f"({dx} * {oy} - {dy} * {ox})"
    along_other = f"try_divide({px} * {dy} - {py} * {dx}, {turn})"
    share = f"try_divide({px} * {oy} - {py} * {ox}, {turn})"
    shares = f"transform({near}, o -> CASE WHEN {along_other} BETWEEN -1e-9D AND 1.000000001D THEN {share} END)"
    return f"array_sort(array_distinct(concat(array(0D, 1D), filter({shares}, t -> t > 0 AND t < 1))))"


def _band(part: str, y: str) -> str:
    """The number of the band of a prepared part that a height falls in."""
    return f"CAST(greatest(least(floor(({y} - {part}.box.min_y) / {part}.step), size({part}.bands) - 1), 0) AS INT)"


def _bands_between(part: str, low: str, high: str) -> str:
    first, last = _band(part, low), _band(part, high)
    return f"flatten(slice({part}.bands, {first} + 1, {last} - {first} + 1))"


def _edge_inside(edge: str, part: str, tolerance: float) -> str:
    """Does an edge stay in a closed part? Cut where it meets the boundary, each piece is wholly in or out.

    Only edges in the bands of heights that the edge passes can cut it or bound it.
    """
    low = f"least({edge}.y1, {edge}.y2) - {tolerance!r}D"
    high = f"greatest({edge}.y1, {edge}.y2) + {tolerance!r}D"
    middles = _let(_cuts(edge, "near"), "cuts", _pairs("cuts", "m1", "m2", "(m1 + m2) / 2"))
    place = (
        f"named_struct('x', {edge}.x1 + ({edge}.x2 - {edge}.x1) * m, "
        f"'y', {edge}.y1 + ({edge}.y2 - {edge}.y1) * m)"
    )
    level = f"get({part}.bands, {_band(part, 'p.y')})"
    inside = f"{_on_boundary('p.x', 'p.y', 'near', tolerance)} OR {_odd_crossings('p.x', 'p.y', level)}"
    return _let(_bands_between(part, low, high), "near", f"forall(transform({middles}, m -> {place}), p -> {inside})")


def _part_within(inner: str, outer: str, tolerance: float) -> str:
    boxed = (
        f"{inner}.box.min_x >= {outer}.box.min_x - {tolerance!r}D AND {inner}.box.min_y >= {outer}.box.min_y - {tolerance!r}D "
        f"AND {inner}.box.max_x <= {outer}.box.max_x + {tolerance!r}D AND {inner}.box.max_y <= {outer}.box.max_y + {tolerance!r}D"
    )
    # With the whole boundary inside, only a hole of the outer part can be missing from it, and
    # such a hole lies inside as a whole; one of its points tells.
    swallowed = (
        f"exists({outer}.holes, h -> {_odd_crossings('h.x', 'h.y', f'{inner}.edges')} "
        f"AND NOT {_on_boundary('h.x', 'h.y', f'{inner}.edges', tolerance)})"
    )
    contained = f"forall({inner}.edges, e -> {_edge_inside('e', outer, tolerance)})"
    return f"({boxed} AND {contained} AND NOT {swallowed})"


def _closed(points: str) -> str:
    return f"(get({points}, 0) = get({points}, size({points}) - 1))"


def _distinct_points(points: str) -> str:
    """The points without those that repeat their neighbour."""
    return _let(points, "dp", "filter(dp, (c, j) -> j = 0 OR c != get(dp, j - 1))")


def edges_of_distinct_points(points: str) -> str:
    """SQL text: the edges of a ring, none of them of length zero."""
    return _let(_distinct_points(points), "ep", _edges("ep"))


def numbered_edges(points: str) -> str:
    """SQL text: the edges of a ring, none of them of length zero, each with their number ``n``."""
    edge = "named_struct('n', size(ep) - 1, 'x1', e1.x, 'y1', e1.y, 'x2', e2.x, 'y2', e2.y)"
    return _let(_distinct_points(points), "ep", _pairs("ep", "e1", "e2", edge))


def ring_inner_point(points: str) -> str:
    """SQL text: a point strictly inside a simple ring."""
    return _ring_inner_point(points)


def on_edge(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """SQL text: does a point lie on an edge, within the tolerance?"""
    return _on_edge_of(x, y, (x1, y1, x2, y2), TOLERANCE)


def repeated_points_count(geometry: str) -> str:
    """SQL text: how many points of a geometry repeat the one before."""
    counts = f"transform(flatten({geometry}), rp -> size(rp) - size({_distinct_points('rp')}))"
    return f"aggregate({counts}, 0, (total, term) -> total + term)"


def _on_one_line(points: str) -> str:
    """Do all points lie on the line from the first to the one farthest from it?"""
    ox, oy = f"{points}[0].x", f"{points}[0].y"
    far = (
        f"array_sort({points}, (l, r) -> CAST(signum("
        f"((r.x - {ox}) * (r.x - {ox}) + (r.y - {oy}) * (r.y - {oy})) - ((l.x - {ox}) * (l.x - {ox}) + (l.y - {oy}) * (l.y - {oy}))) AS INT))[0]"
    )
    off = f"forall({points}, c -> (fp.x - {ox}) * (c.y - {oy}) - (fp.y - {oy}) * (c.x - {ox}) = 0)"
    return _let(far, "fp", off)


def all_finite(geometry: str) -> str:
    """SQL text: does every point of a geometry have two coordinates whose products stay within doubles?"""
    # NaN compares as larger than any number.
    fine = " AND ".join(f"coalesce(abs(fp.{c}) <= 1e100D, false)" for c in "xy")
    return f"coalesce(forall(flatten(flatten({geometry})), fp -> {fine}), true)"


def ring_problem_code(geometry: str, codes: dict[str, int]) -> str:
    """SQL text: the least code of the problems that single rings show, null if none does."""
    each = _let(
        _distinct_points("ring"),
        "rd",
        f"CASE WHEN size(rd) < 4 AND {_closed('ring')} OR size(rd) < 3 THEN {codes['Too few points']} "
        f"WHEN NOT {_closed('ring')} THEN {codes['Ring not closed']} "
        f"WHEN {_on_one_line('rd')} THEN {codes['Zero area']} END",
    )
    return (
        f"CASE WHEN {geometry} IS NULL OR size(flatten({geometry})) = 0 THEN {codes['Empty geometry']} "
        f"WHEN NOT {all_finite(geometry)} THEN {codes['Coordinates not finite']} "
        f"ELSE array_min(transform(flatten({geometry}), ring -> {each})) END"
    )


def _repaired_ring(points: str, outer: str) -> str:
    closed = (
        f"CASE WHEN size({points}) > 0 AND NOT {_closed(points)} "
        f"THEN concat({points}, slice({points}, 1, 1)) ELSE {points} END"
    )
    distinct = _let(closed, "cs", "filter(cs, (c, j) -> j = 0 OR c != get(cs, j - 1))")
    turned = f"CASE WHEN ({_signed_area('ds')} > 0) = ({outer}) THEN ds ELSE reverse(ds) END"
    return _let(distinct, "ds", turned)


# --- public column functions ---------------------------------------------------------------


def area(geometry: str) -> Column:
    """Planar area: outer rings minus holes."""
    return F.expr(_area(geometry))


def area_km2(geometry: str) -> Column:
    """Area in square kilometres of a geometry in metres."""
    return area(geometry) / 1_000_000


def num_points(geometry: str) -> Column:
    return F.size(F.flatten(F.flatten(geometry)))


def bounds(geometry: str) -> Column:
    """The bounding box as a struct ``min_x, min_y, max_x, max_y``."""
    return F.expr(_geometry_bounds(geometry))


def is_box(geometry: str) -> Column:
    """Is the geometry one axis-aligned rectangle? Then containment in it is a comparison of boxes."""
    box_area = _let(_geometry_bounds(geometry), "bx", "(bx.max_x - bx.min_x) * (bx.max_y - bx.min_y)")
    return F.expr(f"size({geometry}) = 1 AND size(flatten({geometry})) = 1 AND {_area(geometry)} = {box_area}")


def _outlines(geometry: str) -> str:
    """Edges and box of each part."""
    return (
        f"transform({geometry}, part -> named_struct("
        f"'edges', flatten(transform(part, ring -> {edges_of_distinct_points('ring')})), "
        f"'box', {_let('flatten(part)', 'corners', _bounds('corners'))}))"
    )


def _prepared(geometry: str) -> str:
    """Each part's box, a point inside each hole, and its edges by bands of heights, about the root of their number."""
    holes = "slice(part, 2, greatest(size(part) - 1, 0))"
    count = "CAST(greatest(ceil(sqrt(size(es))), 1) AS INT)"
    step = f"greatest((bx.max_y - bx.min_y) / {count}, {TOLERANCE!r}D)"
    banded = (
        f"filter(es, e -> greatest(e.y1, e.y2) >= bx.min_y + bn * st - {TOLERANCE!r}D "
        f"AND least(e.y1, e.y2) <= bx.min_y + (bn + 1) * st + {TOLERANCE!r}D)"
    )
    fields = (
        f"named_struct('bands', transform(sequence(0, {count} - 1), bn -> {banded}), 'step', st, 'box', bx, "
        f"'holes', transform({holes}, ring -> {_ring_inner_point('ring')}))"
    )
    bound = _let(step, "st", fields)
    bound = _let(_let("flatten(part)", "corners", _bounds("corners")), "bx", bound)
    return f"transform({geometry}, part -> {_let(f'flatten(transform(part, ring -> {edges_of_distinct_points("ring")}))', 'es', bound)})"


def prepare(geometry: str) -> Column:
    """What the exact test needs of each part: its edges in bands, its box, a point inside each hole."""
    return F.expr(_prepared(geometry))


def within(inner: str, prepared_outer: str, tolerance: float = TOLERANCE) -> Column:
    """Is every part of ``inner`` inside some part of the outer geometry? Touching its boundary is allowed.

    ``inner`` names a geometry, ``prepared_outer`` a column made by ``prepare``, which is reused
    for all areas compared with it. Each edge of ``inner`` meets the outer edges in the bands of heights it
    passes: about the root of their number, not all of them.
    """
    test = f"exists({prepared_outer}, op -> {_part_within('ip', 'op', tolerance)})"
    return F.expr(f"forall({_outlines(inner)}, ip -> {test})")


def repair(geometry: str) -> Column:
    """Close rings, drop repeated points, turn outer rings counter-clockwise and holes clockwise.

    Rings that cross, touch themselves or have no area stay invalid; check again with ``validity.report``.
    """
    return F.expr(f"transform({geometry}, part -> transform(part, (ring, i) -> {_repaired_ring('ring', 'i = 0')}))")
