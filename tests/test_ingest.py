import datetime as dt
import os
import statistics

import pytest
from pyspark.sql import functions as F

from propstats import session
from propstats.catalog import fixtures as fx
from propstats.operators import qa, sampling
from propstats.plans import ingest
from propstats.sources import sales_csv, tables

TAIL = "F,N,L,1,,HIGH ST,,LONDON,CITY,LONDON,A,A"
LINES = [
    f'"a",100,1995-08-18 00:00,"E1 1AA",{TAIL}',
    f'"b",n/a,1995-08-18 00:00,"E1 1AA",{TAIL}',
    f'"c",300,some day,"E1 1AA",{TAIL}',
    '"d",400',
    f'"e",500,1996-01-01,"",{TAIL}',
    f'"f",600,1996-01-02,"  ",{TAIL}',
    f'"g",,1996-01-03,"E2 1AA",{TAIL}',
    "",
    f'"h",800,1996-01-04,"E1 1AA",{TAIL},extra',
]


def raw_file(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


def test_malformed_lines_are_told_apart_whatever_is_selected(spark, tmp_path):
    raw = sales_csv.read_raw_sales(spark, raw_file(tmp_path))
    counts = sales_csv.record_counts(raw).head()
    assert (counts.raw_lines, counts.parsed, counts.malformed) == (8, 4, 4)
    good = sales_csv.well_formed(raw)
    assert good.count() == good.select("transaction_id").count() == 4
    rows = {r.transaction_id: r for r in good.collect()}
    assert sorted(rows) == ["a", "e", "f", "g"]
    assert rows["a"].date_transfer == dt.date(1995, 8, 18)
    assert rows["e"].postcode is None and rows["g"].price is None
    assert {r.line[1] for r in sales_csv.malformed(raw).collect()} == {"b", "c", "d", "h"}
    assert sales_csv.well_formed(sales_csv.read_raw_sales(spark, raw_file(tmp_path))).count() == 4


def test_ingest_verifies_before_it_retires_the_source(spark, tmp_path):
    source, silver = raw_file(tmp_path), str(tmp_path / "silver")
    report = ingest.ingest(spark, source, silver, str(tmp_path / "report"), probe_year=1996)
    assert report["match"] and report["written"] == 4 and report["probe_rows"] == 3
    assert not report["source_deleted"] and os.path.exists(source)
    stored = tables.read_table(spark, silver)
    plan = stored.where("year = 1996")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    nulls = {r.column_name: r.null_count for r in spark.read.parquet(str(tmp_path / "report/null_counts")).collect()}
    assert nulls == {"price": 1, "date_transfer": 0, "postcode": 1, "property_type": 0}
    assert ingest.ingest(spark, source, silver, retire_source=True)["source_deleted"]
    assert not os.path.exists(source)


def test_year_column_is_kept_for_pruning(spark, tmp_path):
    from propstats.operators.geography import with_geography

    df = spark.createDataFrame([("E1 1AA", dt.date(1999, 1, 1), 1)], "postcode string, date_transfer date, price int")
    tables.write_by_year(df.withColumn("year", F.year("date_transfer")), str(tmp_path / "t"))
    plan = with_geography(spark.read.parquet(str(tmp_path / "t"))).where("year = 1999")
    assert "PartitionFilters: [isnotnull(year" in plan._jdf.queryExecution().executedPlan().toString()


def test_district_numbering_cases(spark):
    codes = ["BR1", "BR2", "BR4", "M2", "M3", "GIR", "E0", "E1", "N1", "N1A", "N2", "W1", "W2", "W2A", "W3"]
    df = spark.createDataFrame([(c,) for c in codes * 2], "postcode_district string")
    rows = {r.postcode_area: (r.numbers, r.no_numbers, r.bad_start, r.has_gap) for r in qa.district_numbering(df).collect()}
    assert rows["BR"] == ("1,2,4", False, False, True)
    assert rows["M"] == ("2,3", False, True, False)
    assert rows["GIR"] == ("", True, False, False)
    assert rows["E"] == ("0,1", False, False, False)
    # W2A has letters W and A, so it is an area of its own.
    assert rows["W"] == ("1,2,3", False, False, False)
    assert rows["NA"][0] == "1"
    middle = spark.createDataFrame([("X1",), ("X2",), ("X-2",), ("X3",)], "postcode_district string")
    assert qa.district_numbering(middle).head().has_gap


@pytest.mark.parametrize(
    "prices",
    [[1, 2, 2, 9], [5, None], [None], [], [1, 70_000], [-70_000, -1, 3], [1, 65_535, 65_536, 200_000], [2**31 - 1, 2**31 - 2]],
)
def test_median_is_exact(spark, prices):
    df = spark.createDataFrame([(p, dt.date(2000, 1, 1)) for p in prices], "price int, date_transfer date")
    row = qa.ranges(df).head()
    known = [p for p in prices if p is not None]
    assert row.median_price == (statistics.median(known) if known else None)
    assert (row.min_price, row.max_price) == (min(known, default=None), max(known, default=None))
    assert row.min_date == (dt.date(2000, 1, 1) if prices else None)


def test_median_gathers_no_prices_in_one_task(spark, sf_dir):
    plan = qa.ranges(fx.sales(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan


def test_key_difference(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "l string")
    right = spark.createDataFrame([("b",), ("c",)], "r string")
    rows = {(r.key, r.only_in) for r in qa.key_difference(left, right, "l", "r", ("left", "right")).collect()}
    assert rows == {("a", "left"), ("c", "right")}


def test_samples_repeat_and_respect_the_cap(spark):
    df = spark.range(20000).selectExpr("CAST(id AS STRING) AS id", "CASE WHEN id % 10 = 0 THEN 'rare' ELSE 'hot' END AS c")
    sampled = sampling.class_samples(df, "c", "id", fraction=0.05, cap=40)
    assert {r.c: r["count"] for r in sampled.groupBy("c").count().collect()} == {"rare": 40, "hot": 40}
    again = sampling.class_samples(df.repartition(5), "c", "id", fraction=0.05, cap=40)
    assert sampled.exceptAll(again).count() == 0
    assert 100 < sampling.hash_sample(df, "id", 0.01).count() < 300
    assert sampling.random_sample(df, 0.5, 10, seed=1).count() == 10
    # However large the cap, a class is ranked in buckets before it is ranked as a whole.
    large = sampling.class_samples(df, "c", "id", fraction=0.2, cap=1500)
    assert {r.c: r["count"] for r in large.groupBy("c").count().collect()}["hot"] == 1500
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number()") >= 2 and "_bucket" in plan


def test_csv_export_and_import(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    tables.write_csv(df, str(tmp_path / "csv"), single_file=True)
    assert len([f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]) == 1
    assert tables.read_csv(spark, str(tmp_path / "csv"), df.schema).exceptAll(df).count() == 0
    assert tables.read_csv(spark, str(tmp_path / "csv")).dtypes == [("k", "string"), ("n", "int")]


def test_a_folder_is_not_retired(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw_file(tmp_path / "in")
    with pytest.raises(ValueError, match="single file"):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "silver"), retire_source=True)
    assert not (tmp_path / "silver").exists()
    report = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "silver"))
    assert report["match"] and not report["source_deleted"]


class Settings:
    """A session's configuration, as far as scratch folders ask for it."""

    def __init__(self, **values):
        self.values = {k.replace("__", "."): v for k, v in values.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.values.get(name, default)


def test_scratch_is_shared_wherever_executors_are_apart():
    shared = Settings(spark__master="spark://host:7077", spark__checkpoint__dir="hdfs://x/y/")
    assert session.scratch_path(shared, "t").startswith("hdfs://x/y/propstats/t-")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_path(Settings(spark__master=master), "t")
    for master in ("local", "local[4]", "local[*]"):
        assert os.path.isdir(session.scratch_path(Settings(spark__master=master), "t").split("/propstats/")[0])
