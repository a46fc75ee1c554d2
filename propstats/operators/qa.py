"""Quality reports. Every report is one aggregation pass; none collects rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propstats.functions.labels import has_space, lenient_date, round_half_up
from propstats.functions.postcode import area_from_district
from propstats.schema import CRITICAL_COLUMNS


def null_counts(df: DataFrame, columns: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    """One row per column: nulls and their share of the rows in percent."""
    total = F.count(F.lit(1))
    counted = df.agg(total.alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns])
    return counted.select("_rows", F.inline(entries)).select(
        "column_name",
        "null_count",
        round_half_up(F.try_divide(F.col("null_count") * 100, F.col("_rows"))).alias("null_pct"),
    )


def number_summary(df: DataFrame, column: str = "price") -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of a column, one row each."""
    value = F.col(column)
    measures = {
        "count": F.count(value).cast("double"),
        "mean": F.avg(value),
        "stddev": F.stddev(value),
        "min": F.min(value).cast("double"),
        "max": F.max(value).cast("double"),
    }
    counted = df.agg(*[measure.alias(name) for name, measure in measures.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("summary"), F.col(name).alias("value")) for name in measures])
    return counted.select(F.inline(entries))


def frequency(df: DataFrame, column: str = "property_type", top: int = 10) -> DataFrame:
    """The most frequent values, ties in value order, with their position."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("num_transactions"))
    ordered = counted.orderBy(F.desc("num_transactions"), F.asc_nulls_last(column)).limit(top)
    position = F.row_number().over(Window.orderBy(F.desc("num_transactions"), F.asc_nulls_last(column)))
    return ordered.withColumn("position", position)


# Width of the buckets in which a median is first looked for. An INT price has at most 65,536 of them,
# and a bucket as many distinct prices.
MEDIAN_BUCKET = 65_536


def ranges(df: DataFrame) -> DataFrame:
    """One row: first and last date, lowest and highest price, median price.

    The median is exact. Sales are counted per price and per bucket of prices; a running count over
    the buckets tells which one or two hold the middle, and another over the prices inside those
    finds it. Neither sees more rows than a bucket has prices, however many sales there are.
    """
    by_price = (
        df.groupBy("price")
        .agg(F.count("price").alias("_n"), F.min("date_transfer").alias("_first"), F.max("date_transfer").alias("_last"))
        .withColumn("_bucket", F.floor(F.col("price") / MEDIAN_BUCKET))
    )
    buckets = by_price.groupBy("_bucket").agg(
        F.sum("_n").alias("_in_bucket"),
        F.min("price").alias("_low"),
        F.max("price").alias("_high"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = buckets.withColumns(
        {"_upto": F.sum("_in_bucket").over(running), "_all": F.sum("_in_bucket").over(everything)}
    ).withColumn("_before", F.col("_upto") - F.col("_in_bucket"))
    # Ranks of the middle two, from 1; of an odd count twice the same.
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = placed.where((F.col("_before") < upper) & (F.col("_upto") >= lower)).select("_bucket", "_before", "_all")
    in_bucket = Window.partitionBy("_bucket").orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by_price.join(middle, "_bucket").withColumn("_rank", F.col("_before") + F.sum("_n").over(in_bucket))
    median = ranked.agg(
        (
            (F.min(F.when(F.col("_rank") >= lower, F.col("price"))) + F.min(F.when(F.col("_rank") >= upper, F.col("price")).cast("double"))) / 2
        ).alias("median_price")
    )
    kept = {"min_date": F.min("_first"), "max_date": F.max("_last"), "min_price": F.min("_low"), "max_price": F.max("_high")}
    overall = buckets.agg(*[measure.alias(name) for name, measure in kept.items()])
    # Two results of one row each, put into one.
    both = overall.unionByName(median, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in [*kept, "median_price"]])


def year_counts(df: DataFrame) -> DataFrame:
    """Rows per year with the year's position from the first and from the last.

    The positions are taken over one row per year, not over the sales.
    """
    counted = df.groupBy("year").agg(F.count(F.lit(1)).alias("num_transactions"))
    return counted.withColumn("from_first", F.row_number().over(Window.orderBy("year"))).withColumn(
        "from_last", F.row_number().over(Window.orderBy(F.desc("year")))
    )


def postcodes_without_space(df: DataFrame, postcode: str = "postcode") -> DataFrame:
    """The distinct postcodes that miss the space between their parts, with their rows."""
    return (
        df.where(F.col(postcode).isNotNull() & ~has_space(postcode))
        .groupBy(postcode)
        .agg(F.count(F.lit(1)).alias("num_transactions"))
    )


def date_validity(df: DataFrame, text: str) -> DataFrame:
    """One row: rows, dates that do not parse, first and last valid date, raw text range."""
    date: Column = lenient_date(text)
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(date.isNull()).alias("invalid_dates"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.min(text).alias("min_text"),
        F.max(text).alias("max_text"),
    )


def district_numbering(df: DataFrame, district: str = "postcode_district") -> DataFrame:
    """Per area: are there district numbers, do they start at 0 or 1, do they run without gaps?

    The number of a district is all its digits; a number that appears twice in the middle of the
    run counts as a gap. Only the distinct district codes of an area are brought together.
    """
    codes = df.where(F.col(district).isNotNull()).groupBy(district).agg(F.lit(1).alias("_one"))
    digits = F.regexp_replace(district, "[^0-9]", "")
    grouped = (
        codes.withColumn("postcode_area", area_from_district(district))
        .withColumn("_number", digits.try_cast("bigint"))
        .groupBy("postcode_area")
        .agg(
            F.count(F.lit(1)).alias("num_districts"),
            F.sort_array(F.collect_list("_number")).alias("_numbers"),
        )
    )
    numbers = F.col("_numbers")
    first = F.get(numbers, F.lit(0))
    # A number other than the first must be one more than the number before it.
    breaks = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(1))),
        lambda i: (F.get(numbers, i) != first) & (F.get(numbers, i) != F.get(numbers, i - 1) + 1),
    )
    return grouped.select(
        "postcode_area",
        "num_districts",
        F.array_join(numbers, ",").alias("numbers"),
        (F.size(numbers) == 0).alias("no_numbers"),
        F.coalesce(~first.isin(0, 1), F.lit(False)).alias("bad_start"),
        F.coalesce(breaks, F.lit(False)).alias("has_gap"),
    )


def key_difference(left: DataFrame, right: DataFrame, left_key: str, right_key: str, labels: tuple[str, str]) -> DataFrame:
    """Keys found on one side only, each tagged with its side.

    Both sides are counted into one grouping instead of two anti-joins, so each is read once.
    """
    tagged = left.select(F.col(left_key).alias("key"), F.lit(True).alias("_left")).unionByName(
        right.select(F.col(right_key).alias("key"), F.lit(False).alias("_left"))
    )
    sides = tagged.groupBy("key").agg(F.bool_or("_left").alias("_in_left"), F.bool_and("_left").alias("_only_left"))
    return sides.where(F.col("_only_left") | ~F.col("_in_left")).select(
        "key", F.when(F.col("_only_left"), labels[0]).otherwise(labels[1]).alias("only_in")
    )
