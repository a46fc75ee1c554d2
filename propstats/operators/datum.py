"""Datum shift by a grid of measured shifts, with the published seven-parameter shift where the grid ends.

The grid is a table of nodes (``col``, ``row``, ``d_lon``, ``d_lat``): how many degrees a point at that node moves. A point's
shift is interpolated between the four nodes of its cell. A geometry is joined to the few cells that its points lie in,
not point by point, so its rings stay in its row, and the join is an ordinary one on (col, row): a grid that adaptive
execution finds small is broadcast, a larger one is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propstats.functions import projection
from propstats.sources.tables import stored


@dataclass(frozen=True)
class ShiftGrid:
    """Where the nodes lie: node (col, row) at ``lon0 + col * step_lon``, ``lat0 + row * step_lat``, in degrees on the old datum."""

    lon0: float
    lat0: float
    step_lon: float
    step_lat: float

    def place(self, p: Column) -> Column:
        return F.struct(((p["x"] - self.lon0) / self.step_lon).alias("u"), ((p["y"] - self.lat0) / self.step_lat).alias("v"))


_CORNERS = [(0, 0), (1, 0), (0, 1), (1, 1)]


def cells(nodes: DataFrame) -> DataFrame:
    """(col, row, shifts): each cell with the shifts of its four nodes, those of its lower side first; cells that lack one are left out."""
    corners = F.array(*[F.struct(F.lit(dc).alias("dc"), F.lit(dr).alias("dr")) for dc, dr in _CORNERS])
    of = nodes.where("d_lon IS NOT NULL AND d_lat IS NOT NULL").select("col", "row", "d_lon", "d_lat", F.explode(corners).alias("c"))
    of = of.select((F.col("col") - F.col("c.dc")).cast("long").alias("col"), (F.col("row") - F.col("c.dr")).cast("long").alias("row"), "c", "d_lon", "d_lat")
    shift = F.struct("d_lon", "d_lat")
    corner = [F.min(F.when((F.col("c.dc") == dc) & (F.col("c.dr") == dr), shift)).alias(f"n{i}") for i, (dc, dr) in enumerate(_CORNERS)]
    full = of.groupBy("col", "row").agg(*corner).where(" AND ".join(f"n{i} IS NOT NULL" for i in range(4)))
    return full.select("col", "row", F.array("n0", "n1", "n2", "n3").alias("shifts"))


def _between(shifts: Column, name: str, u: Column, v: Column) -> Column:
    lower = shifts[0][name] * (1 - u) + shifts[1][name] * u
    upper = shifts[2][name] * (1 - u) + shifts[3][name] * u
    return lower * (1 - v) + upper * v


def reproject_by_grid(df: DataFrame, nodes: DataFrame, grid: ShiftGrid, geometry: str = "geometry") -> DataFrame:
    """A National Grid layer in degrees: by the grid's shift where a point's cell has all four nodes, else by the published one.

    Null geometries stay null. The layer is stored once with its place on the old datum.
    """
    old = F.transform(geometry, lambda part: F.transform(part, projection.grid_to_airy))
    rows = stored(df.select(F.struct(*df.columns).alias("given"), F.monotonically_increasing_id().alias("id"), F.col(geometry).alias("shape"), old.alias("old")), "old_datum")
    cell = lambda p: F.struct(F.floor(grid.place(p)["u"]).cast("long").alias("col"), F.floor(grid.place(p)["v"]).cast("long").alias("row"))
    wanted = rows.select("id", F.explode(F.array_distinct(F.transform(F.flatten(F.flatten("old")), cell))).alias("cell"))
    found = wanted.join(cells(nodes), (F.col("cell.col") == F.col("col")) & (F.col("cell.row") == F.col("row")), "left")
    shifts = found.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("shifts").isNotNull(), F.struct("cell", "shifts")))).alias("known"),
        F.bool_and(F.col("shifts").isNotNull()).alias("covered"),
    )

    def moved(p: Column, series: Column | None) -> Column:
        at = F.try_element_at(F.col("known"), cell(p))
        place = grid.place(p)
        u, v = place["u"] - F.floor(place["u"]), place["v"] - F.floor(place["v"])
        shifted = F.struct((p["x"] + _between(at, "d_lon", u, v)).alias("x"), (p["y"] + _between(at, "d_lat", u, v)).alias("y"))
        return shifted if series is None else F.when(at.isNotNull(), shifted).otherwise(series)

    by_grid = F.transform("old", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: moved(p, None))))
    # Only where some point lies outside the grid is the series worked out.
    mixed = F.zip_with(
        "old", projection.reproject("shape"),
        lambda a, b: F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda p, q: moved(p, q))),
    )
    joined = rows.join(shifts, "id", "left")
    new = F.when(F.col("covered"), by_grid).otherwise(F.when(F.col("known").isNotNull(), mixed))
    # A geometry without points has no cell and stays as it is.
    new = F.when(F.size(F.flatten(F.flatten("old"))) > 0, new).otherwise(F.col("shape"))
    return joined.withColumn("new", new).select(*[F.col("new").alias(c) if c == geometry else F.col("given").getField(c).alias(c) for c in df.columns])
