import os

import pytest
from pyspark.sql import functions as F

from propstats.catalog import fixtures as fx
from propstats.operators import marts
from propstats.operators.geography import with_year
from propstats.plans import areas, gold, publish
from propstats.sources import tables


def test_publish_writes_every_mart(spark, sf_dir, tmp_path):
    silver_path = str(tmp_path / "silver")
    tables.write_by_year(with_year(fx.sales(spark, sf_dir)), silver_path)
    silver = tables.read_table(spark, silver_path)
    written = publish.publish(
        spark, silver, fx.zones(spark, sf_dir), fx.districts(spark, sf_dir), str(tmp_path / "out"), csv_export=True, single_csv=True,
        latest_year=2000, low_volume=0
    )
    stored = {name: spark.read.parquet(path) for name, path in written.items() if name != "csv_export"}
    assert all(df.count() > 0 for df in stored.values())

    level = publish.gold_level(stored["gold"], "district")
    single = gold.level_trends(silver, "district")
    assert level.select(*single.columns).exceptAll(single).count() == 0
    scanned = level._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in scanned

    series, geometry = stored["mart_series"], stored["mart_geometry"]
    assert "geometry" not in series.columns and geometry.count() == geometry.select("PostDist").distinct().count()
    assert marts.rejoin(series, geometry).count() == series.count()
    assert set(series.columns) == set(marts.SERIES_COLUMNS) and set(geometry.columns) == set(marts.GEOMETRY_COLUMNS)
    assert sorted(os.listdir(written["csv_export"])) == ["area_pct_change", "district_pct_change", "sector_pct_change"]
    degrees = stored["mart_geometry_wgs84"]
    assert {r.srid for r in degrees.select("srid").collect()} == {4326} and degrees.count() == geometry.count()
    assert {r.srid for r in geometry.select("srid").collect()} == {27700}
    assert stored["hotspots"].agg(F.max("position")).head()[0] == stored["hotspots"].count()
    assert stored["trends_london"].count() > stored["trends_london_flats"].count()


def test_small_areas_from_a_published_file(spark, sf_dir, tmp_path):
    facts = fx.zone_facts(spark, sf_dir).withColumnsRenamed(fx.PUBLISHED_HEADERS)
    tables.write_csv(facts, str(tmp_path / "indicators"))
    polygons = fx.zone_polygons(spark, sf_dir).withColumnRenamed("LSOACode", "LSOA11CD").drop("srid")
    zones, unmatched = areas.load_small_areas(spark, str(tmp_path / "indicators"), polygons, "LSOA11CD")
    assert zones.count() == polygons.count() and set(fx.PUBLISHED_HEADERS) <= set(zones.columns)
    assert zones.where("isnan(CrimeScore)").count() == 0 and zones.where("CrimeScore IS NULL").count() > 0
    assert zones.select("srid").distinct().head().srid == 27700
    assert unmatched.head().polygons_only == unmatched.head().indicators_only == 0


BOW_TIE = [(0.0, 0.0), (9.0, 9.0), (9.0, 0.0), (0.0, 9.0), (0.0, 0.0)]
FLAT = [(0.0, 0.0), (9.0, 9.0), (4.0, 4.0), (0.0, 0.0)]


@pytest.mark.parametrize(("ring", "flawed"), [(None, False), (BOW_TIE, False), (FLAT, True)])
def test_polygons_are_saved_only_if_all_are_valid(spark, sf_dir, tmp_path, ring, flawed):
    """A bow tie is drawn anew; a ring without area cannot be."""
    layer = fx.districts(spark, sf_dir)
    if ring:
        crossed = spark.createDataFrame([("ZZ9", [[ring]])], "PostDist string, g array<array<array<struct<x:double,y:double>>>>")
        layer = layer.unionByName(crossed.selectExpr("PostDist", "0D min_x", "0D min_y", "9D max_x", "9D max_y", "g AS geometry", "27700 AS srid"))
    codes = spark.createDataFrame([("E1",), ("XX1",)], "postcode_district string")
    report = areas.check_polygons(spark, layer, "PostDist", str(tmp_path / "qa"), codes)
    assert (report["polygons"], report["invalid_before"], report["quarantined"]) == (26 if ring else 25, 1 if ring else 0, 1 if flawed else 0)
    assert (report["layer"] is None) == flawed and os.path.exists(tmp_path / "qa" / "layer") != flawed
    assert spark.read.parquet(str(tmp_path / "qa" / "overlap")).where("only_in = 'transactions'").head().key == "XX1"
