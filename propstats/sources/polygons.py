"""Polygon layers as GeoJSON, one feature per line or one document, or as Parquet with nested geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propstats.functions import geometry as geo
from propstats.sources.tables import stored

_FEATURE = "type string, properties string, geometry struct<type: string, coordinates: string>"
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def _part(rings: Column) -> Column:
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: geo.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
        ),
    )


def _layer(features: DataFrame, properties: T.StructType | str, srid: int) -> DataFrame:
    """Properties, geometry, bounds and reference system of the texts that are features."""
    features = features.select(F.from_json("line", _FEATURE).alias("f")).where(F.col("f.type") == "Feature")
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(coordinates, _POLYGON))).when(
        kind == "MultiPolygon", F.from_json(coordinates, _MULTI)
    )
    shaped = features.select(
        F.from_json("f.properties", properties).alias("p"), F.transform(parts, _part).alias("geometry")
    )
    boxed = shaped.withColumn("box", geo.bounds("geometry"))
    return boxed.select("p.*", "geometry", "box.*", F.lit(srid).alias("srid"))


def read_geojson_lines(spark: SparkSession, path: str, properties: T.StructType | str, srid: int = 4326) -> DataFrame:
    """Features with their properties, geometry, bounds and reference system.

    Polygon and MultiPolygon are read; any other geometry gives null. Lines that are no feature,
    such as the frame of a collection written one feature per line, are left out.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r",\s*$", "").alias("line"))
    return _layer(lines, properties, srid)


_SPLIT = ["file", "start"]


def _offsets(pieces: DataFrame, amount: Column, name: str) -> DataFrame:
    """For each byte range, the sum of ``amount`` over the ranges of its file before it; one row per range is collected."""
    sums = pieces.groupBy(*_SPLIT).agg(F.sum(amount).alias("amount")).collect()
    found, last, before = [], None, 0
    for file, start, total in sorted(sums):
        before = before if file == last else 0
        found.append((file, start, before))
        last, before = file, before + total
    return F.broadcast(pieces.sparkSession.createDataFrame(found, f"file long, start long, {name} long"))


def document_objects(spark: SparkSession, path: str) -> DataFrame:
    """The texts (column ``line``) of the objects one level below the top of JSON documents, one document per file.

    A file is read in byte ranges as pieces that end with a closing brace. What a piece does to the text's state
    is known by itself: how many quotes it has, and how many braces it opens if it begins inside or outside a
    string. Prefix sums, within each range and over the ranges before it, then say where each piece begins: in a string or not,
    how deep, and in which object. So a document of any size is split without any task reading more than a
    range, and an object may lie across ranges.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value"
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rest = F.regexp_replace("plain", r'^[^"]*("|$)', "")
    opened = lambda text: F.regexp_count(F.regexp_replace(text, r'"[^"]*("|$)', ""), F.lit(r"\{"))
    pieces = stored(
        pieces.withColumn("plain", plain).select("file", "start", "id", "value", F.regexp_count("plain", F.lit('"')).alias("quotes"), opened("plain").alias("outside"), opened(rest).alias("inside")),
        "pieces",
    )
    before = Window.partitionBy(*_SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)

    def running(amount: str) -> Column:
        return F.coalesce(F.sum(amount).over(before), F.lit(0))

    def placed(df: DataFrame) -> DataFrame:
        """With the depth at which each piece begins, but for what the ranges before it add, and what it adds."""
        stated = df.join(_offsets(pieces, F.col("quotes"), "quotes_before"), _SPLIT).withColumn("quoted", (F.col("quotes_before") + running("quotes")) % 2)
        closes = (F.col("quoted") + F.col("quotes")) % 2 == 0
        steps = F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside")) - closes.cast("int")
        return stated.withColumns({"closes": closes, "steps": steps})

    numbers = placed(pieces.drop("value"))
    depths = _offsets(numbers, F.col("steps"), "depth_before")

    def deep(df: DataFrame) -> DataFrame:
        known = placed(df).join(depths, _SPLIT).withColumn("depth", F.col("depth_before") + running("steps"))
        return known.withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("steps") == 1)).cast("int"))

    objects = _offsets(deep(pieces.drop("value")), F.col("ends"), "objects_before")
    counted = deep(pieces).join(objects, _SPLIT).withColumn("object", F.col("objects_before") + running("ends"))
    gathered = counted.groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct("start", "id", "depth", "value"))).alias("parts"), F.max("ends").alias("whole"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    # Up to the object's own brace: what stands between objects, and before the first one the document's.
    lead = r'^(?:[^"{]|"(?:[^"\\]|\\.)*")*'
    first = F.when(F.get("parts", F.lit(0))["depth"] == 0, F.regexp_replace("text", lead + r"\{", "")).otherwise(F.col("text"))
    return gathered.where("whole = 1").select("parts", text.alias("text")).select(F.regexp_replace(first, lead, "").alias("line"))


def read_geojson(spark: SparkSession, path: str, properties: T.StructType | str, srid: int = 4326) -> DataFrame:
    """Like ``read_geojson_lines``, from documents that are a FeatureCollection each, laid out in any way."""
    return _layer(document_objects(spark, path), properties, srid)


def _feature_lines(df: DataFrame, properties: list[str], geometry: str) -> DataFrame:
    """One GeoJSON feature per row, in column ``value``; a geometry with one part is written as Polygon."""
    coordinates = F.transform(
        F.col(geometry),
        lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))),
    )
    single = F.size(coordinates) == 1
    shape = F.concat(
        F.lit('{"type":"'),
        F.when(single, "Polygon").otherwise("MultiPolygon"),
        F.lit('","coordinates":'),
        F.when(single, F.to_json(F.get(coordinates, F.lit(0)))).otherwise(F.to_json(coordinates)),
        F.lit("}"),
    )
    line = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
        F.lit(',"geometry":'),
        F.coalesce(shape, F.lit("null")),
        F.lit("}"),
    )
    return df.select(line.alias("value"))


def write_geojson_lines(df: DataFrame, path: str, properties: list[str], geometry: str = "geometry") -> None:
    """One GeoJSON feature per line."""
    _feature_lines(df, properties, geometry).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, properties: list[str], geometry: str = "geometry") -> None:
    """One FeatureCollection in one file, for programs that want it so: finished lines pass through one task."""
    lines = _feature_lines(df, properties, geometry).coalesce(1)
    # In one partition, identifiers count the rows from 0 on.
    first = F.when(F.monotonically_increasing_id() == 0, F.lit('{"type":"FeatureCollection","features":[')).otherwise(F.lit(","))
    body = lines.select(F.concat(first, "value").alias("value"))
    end = F.lit("]}") if not df.isEmpty() else F.lit('{"type":"FeatureCollection","features":[]}')
    body.union(df.sparkSession.range(0, 1, 1, 1).select(end)).coalesce(1).write.mode("overwrite").text(path)
