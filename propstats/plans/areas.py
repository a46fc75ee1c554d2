"""Small-area and polygon inputs: loaded, checked and, where they pass, saved for publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propstats.functions import names, projection
from propstats.operators import qa, repair, socio, validity
from propstats.operators.spatial import with_srid
from propstats.session import owns_scratch
from propstats.sources import tables


def load_small_areas(
    spark: SparkSession,
    indicators_csv: str,
    polygons: DataFrame,
    polygon_key: str,
    schema: T.StructType | None = None,
    srid: int = 27700,
) -> tuple[DataFrame, DataFrame]:
    """Small areas with their indicators, and one row that counts the codes found on one side only.

    Headers become short names and NaN becomes null; polygons without a reference system get ``srid``.
    """
    facts = socio.clean_indicators(names.rename_indicators(tables.read_csv(spark, indicators_csv, schema)))
    layer = with_srid(polygons, srid)
    return socio.with_indicators(layer, facts, polygon_key), socio.unmatched_codes(layer, facts, polygon_key)


@owns_scratch
def check_polygons(
    spark: SparkSession, layer: DataFrame, key: str, path: str, codes: DataFrame | None = None, code: str = "postcode_district"
) -> dict:
    """Repair a polygon layer, report on it, and save it only if every polygon is valid then.

    Rings are closed and turned; polygons that were reported invalid are drawn anew (``operators.repair``).

    Writes below ``path``: ``before`` and ``after`` (validity reports), ``quarantine`` (what stays invalid,
    with its reason), ``numbering`` of the district codes, ``overlap`` with ``codes`` if given, and
    ``layer`` if nothing was put in quarantine. Returns the counts and where the layer lies, if saved.
    """
    root = path.rstrip("/")

    def store(name: str, df: DataFrame) -> DataFrame:
        tables.write_table(df, f"{root}/{name}")
        return tables.read_table(spark, f"{root}/{name}")

    before = store("before", validity.report(layer, key))
    mended = tables.stored(repair.mended(validity.repaired(layer), before, key), "mended")
    after = store("after", validity.report(mended, key))
    good, bad = validity.split(mended, after, key)
    quarantined = store("quarantine", bad).count()
    store("numbering", qa.district_numbering(layer, key))
    if codes is not None:
        store("overlap", qa.key_difference(codes, layer, code, key, ("transactions", "polygons")))
    if not quarantined:
        tables.write_table(good, f"{root}/layer")
    return {
        "polygons": before.count(),
        "invalid_before": before.where(F.col("reason") != validity.VALID).count(),
        "quarantined": quarantined,
        "layer": None if quarantined else f"{root}/layer",
    }


def in_degrees(layer: DataFrame, geometry: str = "geometry") -> DataFrame:
    """A National Grid layer as dashboards read it: WGS84 degrees, without the bounds in metres."""
    return layer.withColumns({geometry: projection.reproject(geometry), "srid": F.lit(4326)}).drop(
        "min_x", "min_y", "max_x", "max_y"
    )
