"""British National Grid (EPSG:27700) to WGS84 (EPSG:4326) as column expressions.

The inverse Transverse Mercator series and the seven-parameter datum shift are the published
ones; the shift is good to about five metres. Work is done point by point inside the row's array:
every step binds its results in a struct, so no term is worked out twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Airy 1830 ellipsoid, National Grid projection, WGS84 ellipsoid, datum shift.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
SCALE = 0.9996012717
LAT0, LON0 = math.radians(49), math.radians(-2)
EAST0, NORTH0 = 400000.0, -100000.0
WGS_A, WGS_B = 6378137.000, 6356752.3141
SHIFT = (446.448, -125.157, 542.060)
SHIFT_SCALE = -20.4894e-6
TURN = tuple(math.radians(seconds / 3600) for seconds in (0.1502, 0.2470, 0.8421))

AIRY_E2 = 1 - AIRY_B**2 / AIRY_A**2
WGS_E2 = 1 - WGS_B**2 / WGS_A**2
_N = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
ARC = (
    1 + _N + 5 / 4 * _N**2 + 5 / 4 * _N**3,
    3 * _N + 3 * _N**2 + 21 / 8 * _N**3,
    15 / 8 * _N**2 + 15 / 8 * _N**3,
    35 / 24 * _N**3,
)
ITERATIONS = 5


def _struct(**values: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in values.items()])


def _meridian_arc(lat: Column) -> Column:
    d, s = lat - LAT0, lat + LAT0
    return (
        AIRY_B
        * SCALE
        * (
            ARC[0] * d
            - ARC[1] * F.sin(d) * F.cos(s)
            + ARC[2] * F.sin(d * 2) * F.cos(s * 2)
            - ARC[3] * F.sin(d * 3) * F.cos(s * 3)
        )
    )


def _footpoint(north: Column) -> Column:
    start = (north - NORTH0) / (AIRY_A * SCALE) + LAT0
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ITERATIONS)),
        start,
        lambda lat, _: lat + (north - NORTH0 - _meridian_arc(lat)) / (AIRY_A * SCALE),
    )


def _airy_degrees(points: Column) -> Column:
    """Grid points to latitude and longitude in radians on the Airy ellipsoid."""
    steps = F.transform(points, lambda p: _struct(east=p["x"] - EAST0, lat=_footpoint(p["y"])))
    steps = F.transform(
        steps,
        lambda p: _struct(
            east=p["east"],
            lat=p["lat"],
            t=F.tan(p["lat"]),
            sec=F.lit(1.0) / F.cos(p["lat"]),
            w=F.lit(1.0) - AIRY_E2 * F.sin(p["lat"]) * F.sin(p["lat"]),
        ),
    )
    steps = F.transform(
        steps,
        lambda p: _struct(
            east=p["east"],
            lat=p["lat"],
            t=p["t"],
            t2=p["t"] * p["t"],
            sec=p["sec"],
            nu=AIRY_A * SCALE / F.sqrt(p["w"]),
            rho=AIRY_A * SCALE * (1 - AIRY_E2) / (p["w"] * F.sqrt(p["w"])),
        ),
    )
    steps = F.transform(
        steps,
        lambda p: _struct(
            lat=p["lat"],
            t=p["t"],
            t2=p["t2"],
            sec=p["sec"],
            rho=p["rho"],
            nu=p["nu"],
            eta2=p["nu"] / p["rho"] - 1,
            ratio=p["nu"] / p["rho"],
            u=p["east"] / p["nu"],
        ),
    )

    def solve(p: Column) -> Column:
        t2, u = p["t2"], p["u"]
        u2 = u * u
        lat = p["lat"] - p["t"] * p["ratio"] * u2 * (
            F.lit(0.5)
            - u2 / 24 * (5 + 3 * t2 + p["eta2"] - 9 * t2 * p["eta2"])
            + u2 * u2 / 720 * (61 + 90 * t2 + 45 * t2 * t2)
        )
        lon = LON0 + p["sec"] * u * (
            1
            - u2 / 6 * (p["ratio"] + 2 * t2)
            + u2 * u2 / 120 * (5 + 28 * t2 + 24 * t2 * t2)
            - u2 * u2 * u2 / 5040 * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2)
        )
        return _struct(lat=lat, lon=lon)

    return F.transform(steps, solve)


def _shift_datum(points: Column) -> Column:
    """Latitude and longitude on Airy to latitude and longitude on WGS84, in radians."""
    steps = F.transform(
        points,
        lambda p: _struct(
            lat=p["lat"], lon=p["lon"], nu=AIRY_A / F.sqrt(1 - AIRY_E2 * F.sin(p["lat"]) * F.sin(p["lat"]))
        ),
    )
    steps = F.transform(
        steps,
        lambda p: _struct(
            x=p["nu"] * F.cos(p["lat"]) * F.cos(p["lon"]),
            y=p["nu"] * F.cos(p["lat"]) * F.sin(p["lon"]),
            z=p["nu"] * (1 - AIRY_E2) * F.sin(p["lat"]),
        ),
    )
    grow, (rx, ry, rz) = 1 + SHIFT_SCALE, TURN
    steps = F.transform(
        steps,
        lambda p: _struct(
            x=SHIFT[0] + grow * p["x"] - rz * p["y"] + ry * p["z"],
            y=SHIFT[1] + rz * p["x"] + grow * p["y"] - rx * p["z"],
            z=SHIFT[2] - ry * p["x"] + rx * p["y"] + grow * p["z"],
        ),
    )
    steps = F.transform(
        steps,
        lambda p: _struct(z=p["z"], r=F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]), lon=F.atan2(p["y"], p["x"])),
    )

    def latitude(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ITERATIONS)),
            F.atan2(p["z"], p["r"] * (1 - WGS_E2)),
            lambda lat, _: F.atan2(
                p["z"] + WGS_E2 * WGS_A * F.sin(lat) / F.sqrt(1 - WGS_E2 * F.sin(lat) * F.sin(lat)), p["r"]
            ),
        )

    return F.transform(steps, lambda p: _struct(lat=latitude(p), lon=p["lon"]))


def _as_xy(points: Column) -> Column:
    return F.transform(points, lambda p: _struct(x=F.degrees(p["lon"]), y=F.degrees(p["lat"])))


def grid_to_airy(points: Column) -> Column:
    """An array of grid points to degrees on the Airy datum (x is longitude, y latitude)."""
    return _as_xy(_airy_degrees(points))


def grid_to_wgs84(points: Column) -> Column:
    """An array of grid points to WGS84 degrees (x is longitude, y latitude)."""
    return _as_xy(_shift_datum(_airy_degrees(points)))


def reproject(geometry: Column | str) -> Column:
    """A whole geometry from the National Grid to WGS84."""
    geometry = F.col(geometry) if isinstance(geometry, str) else geometry
    return F.transform(geometry, lambda part: F.transform(part, grid_to_wgs84))
