import json
import os

import pytest

from propstats.sources import polygons
from tests.test_geometry import HOLED, SQUARE, TRIANGLE, TWO_PARTS, layer

KIND = "id string, note string, more struct<a: array<struct<b: string>>>"
SQUARES = [[[0, 0], [1, 0], [1, 1], [0, 0]]]


def feature(name, note, more=None, geometry=None):
    return {"type": "Feature", "properties": {"id": name, "note": note, "more": more}, "geometry": geometry or {"type": "Polygon", "coordinates": SQUARES}}


# Braces, quotes and escapes inside strings, nested objects, and what stands around features.
NOTES = ["plain", "}", "{", '"', '\\"}', "\\", "\\\\", "}{", '{"type":"Feature"}', "é } 日本", "a\nb}", '"}"', "", "]", ","]


def document(extra=None):
    features = [feature(f"f{i}", note, {"a": [{"b": note}, {"b": "}"}]}) for i, note in enumerate(NOTES * 7)]
    features[3]["geometry"] = {"type": "MultiPolygon", "coordinates": [SQUARES, SQUARES]}
    features[4]["geometry"] = None
    features[5]["geometry"] = {"type": "Polygon", "coordinates": [[[i, i % 7] for i in range(3000)]]}
    return {"type": "FeatureCollection", "name": "x } \" {", "crs": {"type": "name", "properties": {"name": "a{}\\"}}, **(extra or {}), "features": features, "last": {"type": "none"}}


@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
@pytest.mark.parametrize("size", ["512", "5k", "1g"])
def test_any_document_in_any_ranges(spark, tmp_path, layout, size):
    wanted = document()
    path = tmp_path / "doc"
    path.mkdir()
    text = json.dumps(wanted, **layout)
    (path / "one.json").write_text(text, encoding="utf-8")
    (path / "two.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("other", "}")]}) + "\n\n")
    (path / "three.json").write_text('{"features": [], "type": "FeatureCollection"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = polygons.read_geojson(spark, str(path), KIND).collect()
        ranges = polygons.document_objects(spark, str(path))
        assert ranges.count() == len(wanted["features"]) + 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.id: r for r in rows}
    assert len(rows) == len(got) == len(wanted["features"]) + 1
    for f in wanted["features"]:
        r, p = got[f["properties"]["id"]], f["properties"]
        assert (r.note, [x.b for x in r.more.a]) == (p["note"], [x["b"] for x in p["more"]["a"]])
        points = sum(len(ring) for part in r.geometry for ring in part) if r.geometry else 0
        assert points == {3: 8, 4: 0, 5: 3000}.get(int(p["id"][1:]), 4)


def test_no_task_reads_the_whole_file(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(document()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = spark.read.option("lineSep", "}").text(str(path))
        assert lines.rdd.getNumPartitions() >= os.path.getsize(path) // 8192
        plan = polygons.read_geojson(spark, str(path), KIND)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Python" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_round_trip_of_one_document(spark, tmp_path):
    df = layer(spark, [("a", HOLED), ('b"}', TWO_PARTS), ("c", SQUARE), ("none", None), ("t", TRIANGLE)]).repartition(3)
    polygons.write_geojson(df, str(tmp_path / "one"), ["id"])
    files = [f for f in os.listdir(tmp_path / "one") if f.startswith("part")]
    assert len(files) == 1 and len(json.loads((tmp_path / "one" / files[0]).read_text())["features"]) == 5
    back = polygons.read_geojson(spark, str(tmp_path / "one"), "id string", 27700)
    assert back.select("id", "geometry").exceptAll(df).count() == 0 and back.count() == 5
    polygons.write_geojson(df.limit(0), str(tmp_path / "none"), ["id"])
    assert polygons.read_geojson(spark, str(tmp_path / "none"), "id string").count() == 0
