"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query runs over whole tables. The years and thresholds below fit the span of the test data
(its last full year is 2000); the engine's functions take them as parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propstats.catalog import fixtures as fx
from propstats.functions import geometry as geo
from propstats.functions import names, postcode, projection
from propstats.operators import datum, explore, marts, overlap, price_stats, qa, quality, repair, sampling, sketches, socio, spatial, validity
from propstats.operators.geography import counts_by_place, with_geography, with_year
from propstats.plans import areas, changes, gold, ingest
from propstats.schema import ZONE, level_keys
from propstats.session import scratch_path
from propstats.sources import polygons, tables

Query = Callable[[SparkSession, str], DataFrame]

LATEST_YEAR = 2000
SINCE_YEAR = 1999
LOW_VOLUME = 5
SELECTED = ["E1", "N1", "SW1", "BR1", "M1"]
SELECTED_TRENDS = ["E4", "N7", "SW2A", "BR5", "M9A"]

# --- postcodes and zones -------------------------------------------------------------------


def postcode_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = fx.sales(spark, sf_dir).na.drop(subset=["postcode"])
    parts = postcode.with_postcode_parts(sales).withColumn(
        "postcode_parts", F.struct("postcode_area", "postcode_district", "postcode_sector")
    )
    return parts.select("transaction_id", "postcode", "postcode_parts.*")


def postcode_parts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = fx.sales(spark, sf_dir).na.drop(subset=["postcode"])
    return postcode.with_postcode_parts(sales, strict_chars=False).select(
        "transaction_id", "postcode", "postcode_area", "postcode_district", "postcode_sector"
    )


def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_place(fx.sales(spark, sf_dir), [ZONE])


def zone_counts_inner_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = postcode.with_postcode_parts(fx.sales(spark, sf_dir).na.drop(subset=["postcode"]), strict_chars=False)
    return (
        placed.withColumn(ZONE, postcode.inner_outer_zone())
        .groupBy(ZONE)
        .agg(F.count(F.lit(1)).alias("num_transactions"))
    )


def class_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_geography(fx.sales(spark, sf_dir))
    return sampling.class_samples(placed, ZONE, "transaction_id").select(ZONE, "transaction_id", "postcode", "price")


# --- price statistics and trends -----------------------------------------------------------


def area_price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_stats.level_statistics(fx.sales(spark, sf_dir), "area")


def area_price_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.level_trends(fx.sales(spark, sf_dir), "area")


def district_price_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.level_trends(fx.sales(spark, sf_dir), "district")


def sector_price_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.level_trends(fx.sales(spark, sf_dir), "sector")


def multi_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_stats.multi_level_statistics(fx.sales(spark, sf_dir))


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stored(sketches.price_sketches(fx.sales(spark, sf_dir)), "sketches")


def sketch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of two spans of years per district and type, from merged sketches."""
    kept, spans = _sketches(spark, sf_dir), {"early": F.col("year") < SINCE_YEAR, "late": F.col("year") >= SINCE_YEAR}
    keys = ["postcode_district", "property_type"]
    parts = [sketches.merged(kept.where(years), keys).withColumn("span", F.lit(span)) for span, years in spans.items()]
    both = parts[0].unionByName(parts[1])
    return both.select("span", *keys, "num_transactions", F.kll_sketch_get_n_bigint("price_sketch").alias("num_sketched"))


def sketch_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sketches of all years against exact ranks: groups per level and percentile, and whether all are within the bound."""
    sales, kept = with_geography(fx.sales(spark, sf_dir)), _sketches(spark, sf_dir)
    parts = []
    for level in ("area", "district", "sector"):
        keys = [f"postcode_{level}", "property_type"]
        errors = sketches.rank_errors(sketches.quantiles(sketches.merged(kept, keys)), sales, keys)
        parts.append(errors.groupBy("percentile").agg(F.count(F.lit(1)).alias("groups"), (F.max("error") <= sketches.RANK_ERROR).alias("within")).withColumn("level", F.lit(level)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quality_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pass_rate(gold.all_level_trends(fx.sales(spark, sf_dir)), ["level"])


# --- ingest --------------------------------------------------------------------------------


def _raw_csv(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "raw")
    fx.raw_lines(spark, sf_dir).write.text(path)
    return path


def ingest_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.to_silver(spark, _raw_csv(spark, sf_dir), scratch_path(spark, "silver"))


def ingest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, silver = _raw_csv(spark, sf_dir), scratch_path(spark, "silver")
    ingest.to_silver(spark, raw, silver)
    return ingest.reconciliation(spark, raw, silver)


def ingest_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table, and a copy in which a value of some rows went to another column, held against the source by content."""
    raw, silver, swapped = _raw_csv(spark, sf_dir), scratch_path(spark, "silver"), scratch_path(spark, "swapped")
    rows = ingest.to_silver(spark, raw, silver)
    altered = rows.withColumn("locality", F.when(F.col("paon") == "1", F.col("town_city")).otherwise(F.col("locality"))).withColumn(
        "town_city", F.when(F.col("paon") == "1", F.lit(None)).otherwise(F.col("town_city"))
    )
    tables.write_in_lots(altered, swapped, "transaction_id")
    copies = [ingest.verify_against_source(spark, raw, path).withColumn("copy", F.lit(name)) for name, path in (("stored", silver), ("altered", swapped))]
    return copies[0].unionByName(copies[1])


def monthly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after two monthly files."""
    silver, months = scratch_path(spark, "silver"), [scratch_path(spark, "month") for _ in fx.CHANGES]
    ingest.to_silver(spark, _raw_csv(spark, sf_dir), silver)
    for i, path in enumerate(months):
        fx.change_lines(spark, sf_dir, i).write.text(path)
    changes.apply_changes(spark, silver, months)
    return tables.read_table(spark, silver).select("transaction_id", "price", "date_transfer", "postcode", "property_type", "record_status", "year")


def silver_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "silver")
    tables.write_by_year(with_year(fx.sales(spark, sf_dir)), path)
    return qa.year_counts(tables.read_table(spark, path))


# --- quality reports -----------------------------------------------------------------------


def qa_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.null_counts(fx.sales(spark, sf_dir))


def qa_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = qa.number_summary(fx.sales(spark, sf_dir))
    return summary.withColumn("value", F.round("value", 4))


def qa_type_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.frequency(fx.sales(spark, sf_dir))


def qa_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.ranges(fx.sales(spark, sf_dir))


def qa_bad_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.postcodes_without_space(fx.sales(spark, sf_dir))


def qa_invalid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.date_validity(fx.dated_text(spark, sf_dir), "date_text")


def district_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.district_numbering(with_geography(fx.sales(spark, sf_dir)))


def district_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    london = with_geography(fx.sales(spark, sf_dir)).where(F.col(ZONE) != "Outside London")
    return qa.key_difference(
        london, fx.districts(spark, sf_dir), "postcode_district", "PostDist", ("transactions", "polygons")
    )


# --- filters, rankings and counts on the district table ------------------------------------


def _flat_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    trends = gold.level_trends(fx.sales(spark, sf_dir), "district")
    return trends.where((F.col("property_type") == "F") & (F.col("year") <= LATEST_YEAR))


def low_volume_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.drop_low_volume(_flat_trends(spark, sf_dir), LOW_VOLUME, SINCE_YEAR)


def zone_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.select_zone_districts(_flat_trends(spark, sf_dir), ["Greater London"], LOW_VOLUME, SINCE_YEAR)


def hotspot_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.drop_low_volume(_flat_trends(spark, sf_dir), LOW_VOLUME, SINCE_YEAR)
    return marts.hotspots(kept, LATEST_YEAR)


def _district_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_stats.level_statistics(fx.sales(spark, sf_dir), "district")


def _district_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per district, type and year: all that counting needs of the district table."""
    return counts_by_place(fx.sales(spark, sf_dir), level_keys("district"))


def type_counts_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.type_counts(_district_counts(spark, sf_dir), LATEST_YEAR)


def type_counts_all_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.type_counts(_district_counts(spark, sf_dir))


def type_counts_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = marts.type_counts(_district_counts(spark, sf_dir))
    return explore.in_districts(counts, SELECTED_TRENDS, "postcode_district")


# --- small areas and districts -------------------------------------------------------------


def socio_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = fx.zone_facts(spark, sf_dir).withColumnsRenamed(fx.PUBLISHED_HEADERS)
    return socio.clean_indicators(names.rename_indicators(published))


def socio_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = socio.with_indicators(
        fx.zone_polygons(spark, sf_dir).withColumnRenamed("LSOACode", "LSOA11CD"), socio.clean_indicators(fx.zone_facts(spark, sf_dir)), "LSOA11CD"
    )
    return joined.withColumn("area", geo.area("geometry")).drop("geometry", "LSOA11CD")


def socio_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    recoded = fx.zone_polygons(spark, sf_dir).withColumn(
        "LSOA11CD", F.when(F.expr(fx.ZONE_NUMBER) % 40 == 0, F.concat(F.lit("X"), "LSOACode")).otherwise(F.col("LSOACode"))
    )
    return socio.unmatched_codes(recoded, fx.zone_facts(spark, sf_dir), "LSOA11CD")


def spatial_within_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, districts = fx.zone_polygons(spark, sf_dir), fx.districts(spark, sf_dir)
    return socio.place_in_districts(zones, districts).select("LSOACode", "PostDist")


def spatial_within_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, districts = fx.zone_polygons(spark, sf_dir), fx.districts(spark, sf_dir)
    return socio.place_in_districts(zones, districts, "left").select("LSOACode", "PostDist")


def spatial_within_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, districts = fx.zone_polygons(spark, sf_dir), fx.shaped_districts(spark, sf_dir)
    return socio.place_in_districts(zones, districts).select("LSOACode", "PostDist")


def spatial_within_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, districts = fx.zone_polygons(spark, sf_dir), tables.stored(fx.detailed_districts(spark, sf_dir), "detailed")
    return socio.place_in_districts(zones, districts).select("LSOACode", "PostDist")


def spatial_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, districts = fx.zone_polygons(spark, sf_dir), fx.districts(spark, sf_dir)
    return overlap.with_shares(zones, districts, ["PostDist"], "left").select("LSOACode", "PostDist", "shared_area", "share")


def spatial_shares_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared areas with districts that have holes, notches or two parts."""
    zones, districts = fx.zone_polygons(spark, sf_dir), fx.shaped_districts(spark, sf_dir)
    return overlap.with_shares(zones, districts, ["PostDist"]).select("LSOACode", "PostDist", "shared_area")


def population_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People per district, those of small areas across a border divided by area."""
    shares = overlap.with_shares(fx.zones(spark, sf_dir), fx.districts(spark, sf_dir), ["PostDist"])
    people = overlap.apportioned(shares, "PostDist", ["TotalPopulation", "DependentChildren"])
    return people.select("PostDist", *[F.round(c, 4).alias(c) for c in people.columns[1:]])


def district_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = [
        fx.districts(spark, sf_dir).select(F.lit("district").alias("layer"), F.col("PostDist").alias("code"), "geometry"),
        fx.shaped_districts(spark, sf_dir).select(
            F.lit("shaped").alias("layer"), F.col("PostDist").alias("code"), "geometry"
        ),
        fx.zone_polygons(spark, sf_dir).select(
            F.lit("zone").alias("layer"), F.col("LSOACode").alias("code"), "geometry"
        ),
    ]
    layer = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return layer.select("layer", "code", geo.area_km2("geometry").alias("area_km2"))


def _socio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return socio.district_socio(fx.zones(spark, sf_dir), fx.districts(spark, sf_dir))


def district_socio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _socio(spark, sf_dir).drop("geometry")


# --- marts ---------------------------------------------------------------------------------


def _joined(spark: SparkSession, sf_dir: str, indicators: DataFrame | None = None) -> DataFrame:
    trends = gold.level_trends(fx.sales(spark, sf_dir), "district")
    return marts.trends_with_socio(trends, _socio(spark, sf_dir) if indicators is None else indicators)


def district_trends_with_socio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).drop("geometry")


def mart_london_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.in_london(_joined(spark, sf_dir)).drop("geometry")


def _london_flats(spark: SparkSession, sf_dir: str, indicators: DataFrame | None = None) -> DataFrame:
    return marts.in_london(_joined(spark, sf_dir, indicators), "F").drop(*marts.SPREAD_COLUMNS)


def zones_in_london(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = socio.place_in_districts(fx.zone_polygons(spark, sf_dir), fx.districts(spark, sf_dir), "left")
    return marts.rows_with_key_in(placed, _london_flats(spark, sf_dir)).select("LSOACode", "PostDist")


def mart_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicators = tables.stored(_socio(spark, sf_dir), "socio")
    mart = marts.geometry_mart(indicators, _london_flats(spark, sf_dir, indicators))
    return mart.withColumn("num_points", geo.num_points("geometry")).drop("geometry")


def mart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.series_mart(_london_flats(spark, sf_dir))


def mart_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicators = tables.stored(_socio(spark, sf_dir), "socio")
    series = tables.stored(marts.series_mart(_london_flats(spark, sf_dir, indicators)), "series")
    return marts.rejoin(series, marts.geometry_mart(indicators, series)).drop("geometry")


def first_values_per_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _district_stats(spark, sf_dir).where(F.col("property_type") == "F")
    columns = ["avg_price", "stddev_price", "skewness_price", "kurtosis_price"]
    return marts.first_values(stats, "postcode_district", "year", columns)


def price_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.price_graph(marts.in_london(_joined(spark, sf_dir)))


# --- dashboard selections ------------------------------------------------------------------


def selection_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = marts.rows_with_key_in(fx.districts(spark, sf_dir), _london_flats(spark, sf_dir))
    return spatial.extent(selected)


def choropleth_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.color_scale(_joined(spark, sf_dir), "avg_price", ["PostDist", "property_type", "year"])


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.comparison_table(
        explore.in_districts(_joined(spark, sf_dir), SELECTED),
        LATEST_YEAR,
        ["postcode_district", "property_type", "avg_price", "roll_median_pct_5_year", "CrimeAvg"],
    )


def price_series_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = marts.price_graph(gold.level_trends(fx.sales(spark, sf_dir), "district"))
    return explore.price_series(graph, SELECTED_TRENDS)


def scatter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.scatter_rows(_joined(spark, sf_dir), "CrimeAvg", "avg_price")


def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.filter_options(
        _district_counts(spark, sf_dir),
        {"zone": ZONE, "district": "postcode_district", "property_type": "property_type", "year": "year"},
    )


# --- geometry ------------------------------------------------------------------------------


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "geojson")
    zones = fx.zones(spark, sf_dir).select("LSOACode", "LADName", "OverallScore", "geometry")
    polygons.write_geojson_lines(zones, path, ["LSOACode", "LADName", "OverallScore"])
    layer = polygons.read_geojson_lines(spark, path, "LSOACode string, LADName string, OverallScore double", 27700)
    return layer.withColumn("area", geo.area("geometry")).withColumn("num_points", geo.num_points("geometry")).drop(
        "geometry"
    )


def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.report(tables.stored(fx.flawed_zones(spark, sf_dir), "flawed"), "LSOACode")


def geometry_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    mended = tables.stored(validity.repaired(fx.flawed_zones(spark, sf_dir)), "mended")
    areas = mended.select("LSOACode", geo.area("geometry").alias("area"))
    return validity.report(mended, "LSOACode").join(areas, "LSOACode")


def geometry_interiors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons whose holes touch the border or each other, and coordinates that are not finite."""
    return validity.report(tables.stored(fx.cut_zones(spark, sf_dir), "cut"), "LSOACode").drop("repeated_points")


def geometry_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both flawed layers drawn anew: what they are then, their parts and area."""
    layers = [fx.flawed_zones(spark, sf_dir), fx.cut_zones(spark, sf_dir)]
    named = [df.withColumn("LSOACode", F.concat(F.lit(name), "LSOACode")) for name, df in zip(("flawed ", "cut "), layers)]
    layer = tables.stored(named[0].unionByName(named[1]), "layers")
    mended = tables.stored(repair.mended(layer, validity.report(layer, "LSOACode"), "LSOACode"), "mended")
    checked = validity.report(mended, "LSOACode").drop("repeated_points")
    shapes = mended.select("LSOACode", F.size("geometry").alias("num_parts"), geo.area("geometry").alias("area"))
    valid = F.col("reason") == validity.VALID
    return checked.join(shapes, "LSOACode").select(
        "LSOACode", "reason", F.when(valid, F.col("num_parts")).alias("num_parts"), F.when(valid, F.col("area")).alias("area")
    )


def small_area_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "indicators")
    tables.write_csv(fx.zone_facts(spark, sf_dir).withColumnsRenamed(fx.PUBLISHED_HEADERS), path)
    polygons_only = fx.zone_polygons(spark, sf_dir).withColumnRenamed("LSOACode", "LSOA11CD").drop("srid")
    joined, _ = areas.load_small_areas(spark, path, polygons_only, "LSOA11CD")
    return joined.withColumn("area", geo.area("geometry")).drop("geometry", "LSOA11CD")


def polygon_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays invalid after repair, with its reason."""
    mended = tables.stored(validity.repaired(fx.flawed_zones(spark, sf_dir)), "mended")
    _, bad = validity.split(mended, validity.report(mended, "LSOACode"), "LSOACode")
    return bad.select("LSOACode", "reason", geo.num_points("geometry").alias("num_points"))


def reproject_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of every zone in degrees, with its place in the ring."""
    # The zones' squares, moved to where the grid has land.
    moved = F.transform("geometry", lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: geo.point(F.lit(530000) + p["x"] * 100, F.lit(180000) + p["y"] * 100))))
    layer = areas.in_degrees(fx.zone_polygons(spark, sf_dir).withColumn("geometry", moved))
    points = layer.select("LSOACode", "srid", F.posexplode(F.flatten(F.flatten("geometry"))).alias("place", "p"))
    return points.select("LSOACode", "srid", "place", F.round("p.x", 7).alias("lon"), F.round("p.y", 7).alias("lat"))


def reproject_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = F.array(geo.point(F.lit(530000) + F.col("min_x") * 100, F.lit(180000) + F.col("min_y") * 100))
    wgs84 = fx.zone_polygons(spark, sf_dir).select("LSOACode", projection.grid_to_wgs84(corner)[0].alias("p"))
    return wgs84.select("LSOACode", F.round("p.x", 7).alias("lon"), F.round("p.y", 7).alias("lat"))


def reproject_by_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the zones' squares by a grid of shifts that covers some of them."""
    corners = F.expr("array(array(array(named_struct('x', 530000 + min_x * 100, 'y', 180000 + min_y * 100), named_struct('x', 530000 + max_x * 100, 'y', 180000 + max_y * 100))))")
    layer = fx.zone_polygons(spark, sf_dir).select("LSOACode", corners.alias("geometry"))
    moved = datum.reproject_by_grid(layer, fx.shift_nodes(spark, sf_dir), datum.ShiftGrid(*fx.SHIFT_GRID))
    points = moved.select("LSOACode", F.posexplode(F.flatten(F.flatten("geometry"))).alias("place", "p"))
    return points.select("LSOACode", "place", F.round("p.x", 7).alias("lon"), F.round("p.y", 7).alias("lat"))


def geojson_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones written as one FeatureCollection in one file, read back in byte ranges."""
    path = scratch_path(spark, "geojson")
    zones = fx.zones(spark, sf_dir).select("LSOACode", "LADName", "OverallScore", "geometry")
    polygons.write_geojson(zones, path, ["LSOACode", "LADName", "OverallScore"])
    layer = polygons.read_geojson(spark, path, "LSOACode string, LADName string, OverallScore double", 27700)
    return layer.withColumn("area", geo.area("geometry")).withColumn("num_points", geo.num_points("geometry")).drop("geometry")


def queries() -> dict[str, Query]:
    listed: list[Query] = [
        area_price_trends,
        area_price_stats,
        district_price_trends,
        sector_price_trends,
        multi_level_stats,
        sketch_counts,
        sketch_rank_error,
        quality_pass_rate,
        postcode_parts,
        postcode_parts_raw,
        zone_counts,
        zone_counts_inner_outer,
        class_samples,
        ingest_csv_roundtrip,
        ingest_reconcile,
        ingest_verified,
        monthly_changes,
        silver_partition_counts,
        qa_null_counts,
        qa_price_summary,
        qa_type_frequency,
        qa_ranges,
        qa_bad_postcodes,
        qa_invalid_dates,
        district_numbering,
        district_overlap,
        low_volume_removed,
        zone_selection,
        hotspot_ranking,
        type_counts_latest,
        type_counts_all_years,
        type_counts_selected,
        socio_renamed,
        socio_polygons,
        socio_unmatched,
        spatial_within_inner,
        spatial_within_left,
        spatial_within_shapes,
        spatial_within_detailed,
        spatial_shares,
        spatial_shares_shapes,
        population_by_share,
        district_area,
        district_socio,
        district_trends_with_socio,
        mart_london_all,
        zones_in_london,
        mart_geometry,
        mart_series,
        mart_rejoined,
        first_values_per_district,
        price_graph,
        selection_bounds,
        choropleth_scale,
        comparison_table,
        price_series_selected,
        scatter_rows,
        filter_options,
        geojson_features,
        geometry_validity,
        geometry_repaired,
        geometry_interiors,
        geometry_mended,
        small_area_load,
        polygon_quarantine,
        reproject_layer,
        reproject_points,
        reproject_by_grid,
        geojson_document,
    ]
    return {query.__name__: query for query in listed}
