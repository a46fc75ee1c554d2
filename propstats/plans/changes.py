"""Monthly change files: additions, changes and deletions applied to the silver table by transaction.

A file's records carry the status A, C or D. Per transaction the record of the latest file wins; within one file
a deletion wins over a change and a change over an addition, then the larger record. Only years that hold a named
transaction, before or after, are written again, by dynamic partition overwrite.

The years' new rows are first written in full to a folder beside the table, with a marker last. A job that stops
before the marker has changed nothing; one that stops after it is finished by the next call from that
folder, whatever was overwritten already. Applying the same files again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propstats.operators.geography import with_year
from propstats.schema import SALE_SCHEMA
from propstats.session import owns_scratch
from propstats.sources import sales_csv, tables

KEY = "transaction_id"
_COLUMNS = [field.name for field in SALE_SCHEMA.fields]


def latest_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One record per transaction of the files, oldest first: its status decides whether it stays. Malformed lines and
    those without a transaction or a known status are left out."""
    files = [sales_csv.well_formed(sales_csv.read_raw_sales(spark, path)).withColumn("_file", F.lit(i)) for i, path in enumerate(paths)]
    rows = with_year(reduce(DataFrame.unionByName, files)).where(F.col(KEY).isNotNull() & F.col("record_status").isin("A", "C", "D"))
    weight = F.when(F.col("record_status") == "D", 2).when(F.col("record_status") == "C", 1).otherwise(0)
    record = F.struct("_file", weight.alias("_weight"), *[c for c in (*_COLUMNS, "year") if c != KEY])
    # A record travels whole; of a transaction named very often, each task sends only its latest.
    return rows.groupBy(KEY).agg(F.max(record).alias("r")).select(KEY, "r.*").drop("_file", "_weight").select(*_COLUMNS, "year")


def _pending(silver_path: str) -> str:
    return f"{silver_path.rstrip('/')}_pending"


def _finish(spark: SparkSession, silver_path: str) -> list[int | None]:
    """Bring the rows of a complete pending folder into the table, drop years left empty, and remove the folder.

    A manifest beside the table gets the new fingerprints of these years, and keeps those of the others.
    """
    pending, table = _pending(silver_path), silver_path.rstrip("/")
    years = [r.year for r in spark.read.parquet(f"{pending}/years").collect()]
    rows = spark.read.schema(tables.read_table(spark, table).schema).parquet(f"{pending}/rows")
    filled = {r.year for r in rows.select("year").distinct().collect()}
    tables.write_in_lots(rows, table, KEY, years_only=True)
    for year in set(years) - filled:
        tables.remove(spark, f"{table}/year={'__HIVE_DEFAULT_PARTITION__' if year is None else year}")
    if tables.exists(spark, f"{table}/_manifest"):
        again = spark.read.parquet(f"{pending}/years").withColumnRenamed("year", "again")
        others = tables.read_manifest(spark, table).join(again, F.col("year").eqNullSafe(F.col("again")), "left_anti")
        tables.write_manifest(tables.stored(others.unionByName(tables.fingerprint(rows)), "manifest"), table)
    tables.remove(spark, pending)
    return years


@owns_scratch
def apply_changes(spark: SparkSession, silver_path: str, paths: Sequence[str]) -> dict:
    """Apply change files, oldest first, to the table at ``silver_path`` and say what that came to.

    Returns the years written (those of a call that had stopped come under ``resumed``), and how many transactions
    were added, changed (their record was there before) and deleted, and how many deletions named none.
    Sales without a date have no year to be found by: their records are kept under the table's default partition.
    """
    pending = _pending(silver_path)
    resumed = _finish(spark, silver_path) if tables.exists(spark, f"{pending}/complete") else []
    tables.remove(spark, pending)

    records = tables.stored(latest_records(spark, paths), "records")
    silver = tables.read_table(spark, silver_path)
    # Only keys and years are read of the table to find what is touched.
    held = silver.select(KEY, "year").join(records.select(KEY), KEY, "left_semi")
    held = tables.stored(held.groupBy(KEY).agg(F.collect_set(F.coalesce("year", F.lit(-1))).alias("years")), "held")
    stays = F.col("record_status") != "D"
    outcome = records.join(held, KEY, "left").agg(
        F.count_if(stays & F.col("years").isNull()).alias("added"),
        F.count_if(stays & F.col("years").isNotNull()).alias("changed"),
        F.count_if(~stays & F.col("years").isNotNull()).alias("deleted"),
        F.count_if(~stays & F.col("years").isNull()).alias("unknown"),
    ).head().asDict()
    touched = held.select(F.explode("years").alias("year")).union(records.where(stays).select(F.coalesce("year", F.lit(-1)))).distinct()
    # At most as many as there are years of sales.
    # At most as many as there are years of sales; -1 stands for none.
    years = sorted(r.year for r in touched.collect())
    if years:
        within = F.col("year").isin([y for y in years if y >= 0])
        inside = within | F.col("year").isNull() if -1 in years else within
        kept = silver.where(inside).join(records.select(KEY), KEY, "left_anti").select(*_COLUMNS, "year")
        new = records.where(stays).select(*_COLUMNS, "year")
        tables.write_in_lots(kept.unionByName(new), f"{pending}/rows", KEY)
        spark.createDataFrame([(y if y >= 0 else None,) for y in years], "year int").write.parquet(f"{pending}/years")
        spark.createDataFrame([(True,)], "done boolean").write.parquet(f"{pending}/complete")
        _finish(spark, silver_path)
    return {"years": [y for y in years if y >= 0], "resumed": resumed, **outcome}
