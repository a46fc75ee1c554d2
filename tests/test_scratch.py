import os

import pytest
from pyspark.sql import functions as F

from propstats import session
from propstats.catalog import fixtures as fx
from propstats.operators import repair, validity
from propstats.operators.geography import with_year
from propstats.plans import areas, publish
from propstats.sources import tables


@pytest.fixture
def scratch(spark):
    """Names of the scratch tables there are since the test began."""
    root = os.path.dirname(session.scratch_path(spark, "probe")).removeprefix("file://")

    def names():
        return set(os.listdir(root)) if os.path.exists(root) else set()

    before = names()
    return lambda: sorted(names() - before)


def test_a_scope_removes_what_was_stored_in_it_only(spark, scratch):
    before = tables.stored(spark.range(3).toDF("n"), "before")
    with session.scratch_scope(spark):
        tables.stored(before, "inside")
        with pytest.raises(RuntimeError), session.scratch_scope(spark):
            tables.stored(before, "nested")
            assert len(scratch()) == 3
            raise RuntimeError("a stage failed")
        assert [f.split("-")[0] for f in scratch()] == ["before", "inside"]
    assert [f.split("-")[0] for f in scratch()] == ["before"] and before.count() == 3


def test_a_failing_stage_leaves_nothing_behind(spark, scratch):
    @session.owns_scratch
    def plan(spark):
        first = tables.stored(spark.range(10).toDF("n"), "first")
        tables.stored(first.select(F.expr("assert_true(n < 5)")), "second")

    with pytest.raises(Exception, match="n < 5"):
        plan(spark)
    assert scratch() == []


def test_rounds_keep_one_table(spark, scratch):
    rounds, df = tables.Rounds("round"), spark.range(4).toDF("n")
    for _ in range(4):
        df = rounds.store(df.withColumn("n", F.col("n") + 1))
        assert len(scratch()) == 1
    assert {r.n for r in df.collect()} == {4, 5, 6, 7}


def test_plans_leave_scratch_empty(spark, sf_dir, tmp_path, scratch):
    silver = str(tmp_path / "silver")
    tables.write_by_year(with_year(fx.sales(spark, sf_dir)), silver)
    written = publish.publish(spark, tables.read_table(spark, silver), fx.zones(spark, sf_dir), fx.districts(spark, sf_dir), str(tmp_path / "out"), latest_year=2000)
    assert scratch() == []
    layer = fx.flawed_zones(spark, sf_dir)
    report = areas.check_polygons(spark, layer, "LSOACode", str(tmp_path / "qa"))
    assert report["quarantined"] and scratch() == []
    assert spark.read.parquet(str(tmp_path / "qa" / "quarantine")).count() == report["quarantined"]
    assert all(spark.read.parquet(path).count() for path in written.values())


def test_what_an_operator_returns_can_be_read_later(spark, sf_dir, scratch):
    layer = fx.flawed_zones(spark, sf_dir)
    mended = repair.mended(layer, validity.report(layer, "LSOACode"), "LSOACode")
    assert scratch() and mended.count() == layer.count()
