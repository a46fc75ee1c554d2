import random

from pyspark.sql import functions as F

from propstats.operators import ranking, sketches

KEYS = ["sector", "year"]


def some_sales(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"s{rng.randint(1, 9)}", 2000 + rng.randint(0, 5), int(rng.lognormvariate(12, 1))) for _ in range(60_000)]
    rows += [("small", 2000, p) for p in (5, 1, 9)] + [("small", 2001, 7), ("small", 2001, None), ("none", 2000, None), ("none", 2001, None)]
    return spark.createDataFrame(rows, "sector string, year int, price int").repartition(7)


def test_merged_sketches_hold_their_rank_error(spark):
    sales = some_sales(spark).cache()
    kept = sketches.price_sketches(sales, KEYS).cache()
    for keys, years in ((["sector"], "true"), (["sector"], "year BETWEEN 2001 AND 2003"), ([], "true"), (["year"], "true")):
        coarse = sketches.quantiles(sketches.merged(kept.where(years), keys))
        errors = sketches.rank_errors(coarse, sales.where(years), keys).collect() if keys else []
        assert all(0 <= r.error <= sketches.RANK_ERROR for r in errors)
        counted = sales.where(years).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("p"))
        assert sorted(tuple(r) for r in coarse.select(*keys, "num_transactions", "num_priced").collect()) == sorted(tuple(r) for r in counted.collect())
    plan = sketches.merged(kept, ["sector"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan


def test_small_groups_are_exact_and_groups_without_a_price_null(spark):
    kept = sketches.price_sketches(some_sales(spark), KEYS)
    found = {r.sector: r for r in sketches.quantiles(sketches.merged(kept, ["sector"])).where("sector IN ('small', 'none')").collect()}
    assert (found["small"].num_transactions, found["small"].num_priced) == (5, 4)
    assert (found["small"]["25th_percentile_price"], found["small"].median_price, found["small"]["95th_percentile_price"]) == (1, 5, 9)
    assert found["none"].num_transactions == 2 and found["none"].median_price is None
    assert sketches.price_sketches(some_sales(spark).limit(0), KEYS).count() == 0


def test_rank_errors_are_distances_to_a_values_ranks(spark):
    sales = spark.createDataFrame([("a", p) for p in [1, 2, 2, 2, 3, 4, 5, 6, 7, 8]], "k string, price int")
    names = list(sketches.PERCENTILE_COLUMNS.values())
    found = spark.createDataFrame([("a", 2, 5, 3, 8, 9)], f"k string, {', '.join(f'`{n}` int' for n in names)}")
    got = {r.percentile: round(r.error, 9) for r in sketches.rank_errors(found, sales, ["k"]).collect()}
    assert got == {0.25: 0, 0.5: 0.1, 0.75: 0.25, 0.9: 0, 0.95: 0.05}


def test_positions_without_one_task(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(20)]), i, "x") for i in range(5000)]
    df = spark.createDataFrame(rows, "v int, i int, _before string").repartition(9)
    placed = ranking.with_position(df, F.desc_nulls_last("v"), "i")
    assert placed.columns == ["v", "i", "_before", "position"]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    got = [(r.v, r.i) for r in placed.orderBy("position").collect()]
    assert got == [r[:2] for r in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert [r.position for r in placed.orderBy("position").collect()] == list(range(1, 5001))
    assert ranking.with_position(df.limit(0), "i").count() == 0
    many = spark.range(1000).selectExpr("1 AS same")
    assert sorted(r.position for r in ranking.with_position(many, "same").collect()) == list(range(1, 1001))
