"""Raw CSV to the year-partitioned silver table, with reconciliation and a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propstats.operators import qa, sampling
from propstats.operators.geography import with_year
from propstats.session import owns_scratch
from propstats.sources import sales_csv, tables


def to_silver(spark: SparkSession, csv_path: str, silver_path: str, cluster: bool = True) -> DataFrame:
    """Write the well-formed records by year and return the stored table."""
    rows = with_year(sales_csv.well_formed(sales_csv.read_raw_sales(spark, csv_path)))
    tables.write_by_year(rows, silver_path, cluster)
    return tables.read_table(spark, silver_path)


def reconciliation(spark: SparkSession, csv_path: str, silver_path: str) -> DataFrame:
    """Rows at each step as (step, num_rows): raw lines, parsed, malformed, written.

    The counts come from finished reads, not from counters of the writing job, which count twice
    when a lost executor makes tasks run again.
    """
    steps = ["raw_lines", "parsed", "malformed"]
    counted = sales_csv.record_counts(sales_csv.read_raw_sales(spark, csv_path)).select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("num_rows")) for s in steps]))
    )
    written = tables.read_table(spark, silver_path).agg(F.count(F.lit(1)).alias("num_rows"))
    return counted.unionByName(written.select(F.lit("written").alias("step"), "num_rows"))


def verify_against_source(spark: SparkSession, csv_path: str, silver_path: str) -> DataFrame:
    """Per year, whether the stored rows are those of the source: (year, expected_rows, written_rows, matches)."""
    source = with_year(sales_csv.well_formed(sales_csv.read_raw_sales(spark, csv_path)))
    return tables.compare_content(tables.fingerprint(source), tables.fingerprint(tables.read_table(spark, silver_path)))


def quality_reports(silver: DataFrame) -> dict[str, DataFrame]:
    """The ingest checks as lazy reports on the stored columns."""
    return {
        "null_counts": qa.null_counts(silver),
        "price_summary": qa.number_summary(silver),
        "type_frequency": qa.frequency(silver),
        "ranges": qa.ranges(silver),
        "year_counts": qa.year_counts(silver),
        "postcodes_without_space": qa.postcodes_without_space(silver),
        "sample_without_postcode": sampling.random_sample(silver.where(F.col("postcode").isNull()), 1.0, 20),
        "sample": sampling.random_sample(silver, 0.01, 20),
    }


@owns_scratch
def ingest(
    spark: SparkSession,
    csv_path: str,
    silver_path: str,
    report_path: str | None = None,
    retire_source: bool = False,
    probe_year: int | None = None,
) -> dict:
    """Convert, verify, report; with ``retire_source`` delete the CSV, but only if every row arrived as it was read.

    The stored table is read back and held against the source by content, year by year; when that agrees, the
    fingerprint is left beside the table as its manifest. Only a single file can be retired; a folder is refused
    before anything is converted.
    """
    if retire_source and not tables.is_file(spark, csv_path):
        raise ValueError(f"only a single file can be retired: {csv_path}")
    silver = to_silver(spark, csv_path, silver_path)
    counts = {row.step: row.num_rows for row in reconciliation(spark, csv_path, silver_path).collect()}
    report = {**counts, **tables.verify_table(spark, silver_path, counts["parsed"], probe_year)}
    if report_path is not None:
        for name, table in quality_reports(silver).items():
            tables.write_table(table, f"{report_path.rstrip('/')}/{name}")
    report["content_match"] = verify_against_source(spark, csv_path, silver_path).where(~F.col("matches")).isEmpty()
    if report["content_match"]:
        tables.write_manifest(tables.fingerprint(tables.read_table(spark, silver_path)), silver_path)
    report["source_deleted"] = bool(retire_source and report["match"] and report["content_match"]) and tables.delete_source(spark, csv_path)
    return report
