import math
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from propstats.catalog import fixtures as fx
from propstats.operators import price_stats as ps
from propstats.operators import quality, trends
from propstats.operators.geography import with_geography
from propstats.plans import gold
from propstats.schema import LEVELS, PERCENTILE_COLUMNS, level_keys


def stats_of(spark, prices, **options):
    df = spark.createDataFrame([("g", p) for p in prices], "k string, price int")
    return ps.price_statistics(df, "k", **options).head()


def test_single_row_group(spark):
    row = stats_of(spark, [100])
    assert (row.num_transactions, row.avg_price, row.median_price) == (1, 100.0, 100)
    assert row.stddev_price is None and row.skewness_price is None and row.kurtosis_price is None


def test_zero_variance_and_zero_median(spark):
    row = stats_of(spark, [0, 0, 0])
    assert row.stddev_price == 0.0 and row.skewness_price is None
    assert row.coef_var is None and row.iqr_pct is None and row.median_mean_diff_pct is None


def test_null_prices_count_but_do_not_weigh(spark):
    row = stats_of(spark, [None, 10, None, 30])
    assert (row.num_transactions, row.avg_price, row.median_price) == (4, 20.0, 10)
    empty = stats_of(spark, [None, None])
    assert (empty.num_transactions, empty.avg_price, empty.median_price) == (2, None, None)


def test_percentiles_are_discrete(spark):
    row = stats_of(spark, [10, 20, 30, 40])
    got = [row[name] for name in PERCENTILE_COLUMNS.values()]
    assert got == [10, 20, 30, 40, 40]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force_with_a_hot_group(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", rng.randrange(1, 400)) for _ in range(4000)]
    groups = defaultdict(list)
    for key, price in rows:
        groups[key].append(price)
    got = ps.price_statistics(spark.createDataFrame(rows, "k string, price int"), ["k"]).collect()
    assert len(got) == len(groups)
    for row in got:
        prices = sorted(groups[row.k])
        n, mean = len(prices), sum(prices) / len(prices)
        m2, m3, m4 = (sum((p - mean) ** k for p in prices) / n for k in (2, 3, 4))
        assert row.num_transactions == n
        assert row.avg_price == pytest.approx(mean, abs=0.0501)
        assert row.stddev_price == pytest.approx(statistics.stdev(prices), abs=0.0501)
        assert row.skewness_price == pytest.approx(m3 / m2**1.5, abs=0.00501)
        assert row.kurtosis_price == pytest.approx(m4 / m2**2 - 3, abs=0.00501)
        for p, name in PERCENTILE_COLUMNS.items():
            assert row[name] == prices[math.ceil(round(p * 100) * n / 100) - 1]


def test_sketch_agrees_on_small_groups(spark, sf_dir):
    placed = with_geography(fx.sales(spark, sf_dir))
    exact = ps.price_statistics(placed, level_keys("area"))
    sketch = ps.price_statistics(placed, level_keys("area"), accuracy=100000)
    assert exact.columns == sketch.columns
    assert exact.exceptAll(sketch).count() == 0


def test_hot_group_is_counted_before_it_is_gathered(spark, sf_dir):
    """The first shuffle carries (keys, price, partial count), spread by price as well."""
    stats = ps.price_statistics(with_geography(fx.sales(spark, sf_dir)), level_keys("area"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "price" in first and "partial_count" in plan


def test_levels_hold_the_same_sales(spark, sf_dir):
    sales = fx.sales(spark, sf_dir)
    stats = ps.multi_level_statistics(sales).cache()
    totals = {r.level: r.n for r in stats.groupBy("level").agg(F.sum("num_transactions").alias("n")).collect()}
    known = sales.where("postcode is not null").count()
    assert totals == dict.fromkeys(LEVELS, known)
    quantiles = list(PERCENTILE_COLUMNS.values())
    disorder = " OR ".join(f"`{a}` > `{b}`" for a, b in zip(quantiles, quantiles[1:]))
    assert stats.where(disorder).count() == 0
    single = ps.price_statistics(with_geography(sales), level_keys("district"))
    rolled = stats.where("level = 'district'").select(*single.columns)
    assert single.exceptAll(rolled).count() == 0 and rolled.exceptAll(single).count() == 0
    stats.unpersist()


def test_trends_of_all_levels_match_single_levels(spark, sf_dir):
    sales = fx.sales(spark, sf_dir)
    every = gold.all_level_trends(sales)
    for level in LEVELS:
        single = gold.level_trends(sales, level)
        rows = every.where(F.col("level") == level).select(*single.columns)
        assert single.exceptAll(rows).count() == 0


def series(spark, medians):
    rows = [("a", year, median) for year, median in medians]
    return spark.createDataFrame(rows, "k string, year int, median_price int")


def test_trend_frames_and_zero_fill(spark):
    rows = trends.price_trends(series(spark, [(2000, 100), (2001, 110), (2004, 121), (2005, 0), (2006, 50)]), ["k", "year"])
    got = rows.orderBy("year").collect()
    assert [r.lag_median_price for r in got] == [0, 100, 110, 121, 0]
    assert [r.median_pct_change_1_year for r in got] == [0.0, 10.0, 10.0, -100.0, 0.0]
    # A change from zero is undefined, so the mean of the last two rows is the one before.
    assert [r.roll_median_pct_2_year for r in got] == [0.0, 10.0, 10.0, -45.0, -100.0]
    assert got[-1].roll_median_pct_5_year == pytest.approx(-26.7)


def test_large_price_change_does_not_overflow(spark):
    rows = trends.price_trends(series(spark, [(2000, 1), (2001, 2_000_000_000)]), ["k"]).orderBy("year").collect()
    assert rows[1].median_pct_change_1_year == pytest.approx(1999999999 * 100.0)


def test_quality_flag_and_pass_rate(spark):
    rows = [(30, 50.0, 10.0, 25.0), (29, 1.0, 1.0, 1.0), (30, 50.1, 1.0, 1.0), (99, 1.0, 20.0, 1.0), (99, 1.0, 1.0, 25.1)]
    df = spark.createDataFrame(rows, "num_transactions long, coef_var double, median_mean_diff_pct double, iqr_pct double")
    strict = quality.with_quality_flag(df, quality.GOLD_THRESHOLDS)
    assert [r.is_good_sample for r in strict.collect()] == [True, False, False, False, False]
    assert [r.is_good_sample for r in quality.with_quality_flag(df).collect()] == [True, False, False, True, False]
    rate = quality.pass_rate(strict).head()
    assert (rate.good_samples, rate.total_samples, rate.pass_rate_pct) == (1, 5, 20.0)


def test_low_volume_rule_drops_whole_keys(spark):
    rows = [("A", 2017, 1), ("A", 2018, 61), ("B", 2018, 60), ("B", 2019, 500), (None, 2019, 1)]
    df = spark.createDataFrame(rows, "postcode_district string, year int, num_transactions long")
    kept = quality.drop_low_volume(df, 60, 2018).collect()
    assert Counter(r.postcode_district for r in kept) == {"A": 2, None: 1}
