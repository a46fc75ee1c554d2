import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from propstats.catalog import check, oracle
from propstats.catalog import queries as catalog
from propstats.operators import marts


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check.connect(sf_dir)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert duckdb.__version__


def test_entry(spark):
    flagship = contract.entry(spark)
    assert "is_good_sample" in flagship.columns and flagship.limit(1).count() == 1


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_agrees_with_sql(spark, sf_dir, connection, name):
    problems, rows = check.compare(contract.queries()[name](spark, sf_dir), connection, contract.oracle_sql()[name])
    assert not problems
    assert rows > 0


def test_hotspots_come_sorted(spark, sf_dir):
    rows = catalog.hotspot_ranking(spark, sf_dir).collect()
    keys = [(-r[marts.LATEST_METRIC], r.postcode_district, -r.year) for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(1, len(rows) + 1))


def test_selections_read_only_what_they_need(spark, sf_dir):
    plan = catalog.type_counts_selected(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # Counting sales needs no prices.
    assert "ReadSchema" in plan and "l_extendedprice" not in plan


def test_no_query_runs_python_per_row_or_joins_all_pairs(spark, sf_dir):
    for name in ("area_price_trends", "spatial_within_shapes", "mart_rejoined", "class_samples"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for operator in ("EvalPython", "CartesianProduct", "NestedLoopJoin"):
            assert operator not in plan, (name, operator)


def test_first_values_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, 7, None), ("a", 3, 8, 6)], "k string, y int, u int, v int")
    row = marts.first_values(df, "k", F.col("y"), ["u", "v"]).head()
    assert (row.u, row.v) == (7, 5)


def test_stored_results_are_not_computed_twice(spark, sf_dir, monkeypatch):
    """Each query plans the sales once, however many of its parts read what comes of them."""
    real, planned = catalog.fx.sales, []
    monkeypatch.setattr(catalog.fx, "sales", lambda *a: planned.append(1) or real(*a))
    for name in ("choropleth_scale", "mart_rejoined", "sketch_counts"):
        planned.clear()
        assert contract.queries()[name](spark, sf_dir).count() > 0
        assert len(planned) == 1, name


def test_a_copy_of_a_table_by_year_is_rebalanced_in_lots(spark, sf_dir, monkeypatch):
    # The copy reads what lies by year: a task's rows of a year are split only if they are dealt into lots.
    plans, plain = [], catalog.tables.write_by_year

    def noted(df, path, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        plain(df, path, *args)

    monkeypatch.setattr(catalog.tables, "write_by_year", noted)
    assert {(r.copy, r.matches) for r in catalog.ingest_verified(spark, sf_dir).collect()} == {("stored", True), ("altered", False)}
    assert len(plans) == 2 and "RebalancePartitions [year" in plans[1] and "_lot" in plans[1]
