import re

import pytest
from pyspark.sql import functions as F

from propstats.functions import labels
from propstats.functions import postcode as pc

CODES = [
    "SW1A 1AA", "BT7 3AP", "E1W 2AA", "WC1A 1AY", " n6  5UQ", "L-1 2AB", "EC50 1AA", "M1", "W1A 1AA",
    "N1\t9GU", "ÉC1 2AB", "M1 2AB", "B33 8TH extra", "-- 1AA", "\x1fGIR 0AA",
]


def restated(code, strict=True):
    """The definition in plain Python: first two words, letters, letters and digits."""
    words = code.split()
    district = re.sub("[^A-Za-z0-9]", "", words[0]) if strict else words[0]
    sector = f"{district}-{words[1][0]}" if len(words) > 1 else "Unknown"
    return re.sub("[^A-Za-z]", "", words[0]), district, sector


@pytest.mark.parametrize("strict", [True, False])
def test_parts_follow_the_definition(spark, strict):
    df = spark.createDataFrame([(c,) for c in CODES], "postcode string")
    rows = pc.with_postcode_parts(df, strict_chars=strict).collect()
    for row in rows:
        got = (row.postcode_area, row.postcode_district, row.postcode_sector)
        assert got == restated(row.postcode, strict), row.postcode


def test_null_and_blank_are_unknown(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("\t",)], "postcode string")
    for row in pc.with_postcode_parts(df).collect():
        assert (row.postcode_area, row.postcode_district, row.postcode_sector) == ("Unknown",) * 3


def test_area_modes(spark):
    df = spark.createDataFrame([("SW1A",), ("EC1",), ("GIR",)], "d string")
    rows = df.select(
        pc.area_from_district("d").alias("all"), pc.area_from_district("d", "leading_letters").alias("lead")
    ).collect()
    assert [(r["all"], r["lead"]) for r in rows] == [("SWA", "SW"), ("EC", "EC"), ("GIR", "GIR")]
    with pytest.raises(ValueError):
        pc.area_from_district("d", "other")


def test_london_zones(spark):
    cases = [
        ("EC", "EC1A", "Central London", "Inner London"),
        ("W", "W1", "Central London", "Inner London"),
        ("N", "N1", "Central London", "Inner London"),
        ("N", "N2", "Greater London", "Inner London"),
        ("BR", "BR1", "Greater London", "Outer London"),
        ("CR", "CR0", "Greater London", "Outside London"),
        ("ME", "ME1", "Outside London", "Outside London"),
        ("ec", "ec1", "Outside London", "Outside London"),
        ("SWA", "SW1A", "Outside London", "Outside London"),
        (None, "EC2A", "Unknown", "Unknown"),
    ]
    df = spark.createDataFrame(cases, "postcode_area string, postcode_district string, zone string, ring string")
    for row in df.withColumn("z", pc.london_zone()).withColumn("r", pc.inner_outer_zone()).collect():
        assert (row.z, row.r) == (row.zone, row.ring)


def test_codes_are_never_null_to_catalyst(spark):
    df = pc.with_postcode_parts(spark.createDataFrame([("E1 1AA",)], "postcode string"))
    nullable = {f.name: f.nullable for f in df.schema.fields}
    assert not nullable["postcode_district"] and not nullable["postcode_sector"]


def test_labels(spark):
    df = spark.createDataFrame([("F", "1999-02-30", 2001), ("X", "1999-02-03", 2002)], "t string, d string, y int")
    rows = df.select(
        labels.property_type_name("t").alias("name"),
        labels.lenient_date("d").alias("date"),
        labels.year_start("y").alias("start"),
        labels.guarded_percent(F.lit(1), F.lit(0)).alias("guarded"),
        labels.guarded_percent(F.lit(1), F.lit(3)).alias("third"),
    ).collect()
    assert rows[0].name == "Flat" and rows[1].name is None
    assert rows[0].date is None and str(rows[1].date) == "1999-02-03"
    assert str(rows[1].start) == "2002-01-01"
    assert rows[0].guarded == 0.0 and rows[0].third == 33.33
