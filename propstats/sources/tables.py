"""Parquet tables and headered CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propstats.session import remove_folder, scratch_path


#: Into how many lots a year is dealt where one task may read much of it.
LOTS = 4


def write_by_year(df: DataFrame, path: str, cluster: bool = True, years_only: bool = False) -> None:
    """Overwrite ``path`` with Snappy Parquet in one directory per year; with ``years_only`` just the years that ``df`` holds.

    With ``cluster`` the rows are first rebalanced by year: adaptive execution merges small years
    and splits a hot one by size, so files come out evenly sized whatever the share of a year.
    Each task sorts its rows by year: rebalanced, these are at most one partition of the size adaptive execution
    aims at, however large the table; without, as much as a file split holds when it is read.
    """
    rows = df.hint("rebalance", F.col("year")) if cluster else df
    writer = rows.write.mode("overwrite").partitionBy("year").option("compression", "snappy")
    (writer.option("partitionOverwriteMode", "dynamic") if years_only else writer).parquet(path)


def write_in_lots(df: DataFrame, path: str, key: str, years_only: bool = False) -> None:
    """``write_by_year`` for rows that already lie by year: what one task reads of a year goes to several lots, by a key.

    Rebalancing splits a year between the tasks that read it, but not what one of them read.
    """
    lots = df.withColumn("_lot", F.pmod(F.xxhash64(key), F.lit(LOTS))).hint("rebalance", "year", "_lot").drop("_lot")
    write_by_year(lots, path, False, years_only)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to shared scratch and read it back, so that several readers compute it once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table worked out in rounds: each round is stored, and the one it was made from removed then."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def store(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, scratch_path(df.sparkSession, self.name)
        df.write.parquet(path)
        if self.path is not None:
            remove_folder(spark, self.path)
        self.path = path
        return spark.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A headered CSV; types are inferred only where no schema is given."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A headered CSV export.

    ``single_file`` shuffles the finished rows into one task. It is meant for small results that
    another program wants as one file; the work before the shuffle stays distributed.
    """
    (df.repartition(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def verify_table(spark: SparkSession, path: str, expected_rows: int, probe_year: int | None = None) -> dict:
    """Read a year-partitioned table back: row count, match, and rows of one year read by pruning."""
    stored = spark.read.parquet(path)
    rows = stored.count()
    report = {"expected": expected_rows, "written": rows, "match": rows == expected_rows}
    if probe_year is not None:
        report["probe_rows"] = stored.where(F.col("year") == probe_year).count()
    return report


def fingerprint(df: DataFrame, by: Sequence[str] = ("year",), columns: Sequence[str] | None = None) -> DataFrame:
    """Per partition, a fingerprint of its rows as a multiset: their number and the sums of two independent row hashes.

    The order of rows and of columns does not count, repeats do, and null differs from any value. One pass, and one
    row per partition and task is all that is shuffled. ``columns`` default to all but the partition's.
    """
    names = sorted(columns if columns is not None else [c for c in df.columns if c not in by])
    # A hash passes over nulls: which columns are null is hashed as text of its own.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names]) if names else F.lit("")
    hashes = [F.xxhash64(F.lit(salt), nulls, *[F.col(c) for c in names]).cast("decimal(20,0)") for salt in ("first", "second")]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_rows"), *[F.sum(h).cast("decimal(38,0)").alias(f"hash_{i}") for i, h in enumerate(hashes, 1)]
    )


_PRINT = ["num_rows", "hash_1", "hash_2"]


def compare_content(expected: DataFrame, found: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Two fingerprints side by side: (by, expected_rows, written_rows, matches); partitions of one side only do not match."""
    same = F.lit(True)
    for c in _PRINT:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    keys = F.lit(True)
    for c in by:
        keys = keys & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = expected.alias("e").join(found.alias("f"), keys, "full_outer")
    named = [F.coalesce(f"e.{c}", f"f.{c}").alias(c) for c in by]
    count = {"expected_rows": "e.num_rows", "written_rows": "f.num_rows"}
    return joined.select(*named, *[F.coalesce(F.col(c), F.lit(0)).alias(name) for name, c in count.items()], same.alias("matches"))


def write_manifest(content: DataFrame, path: str) -> None:
    """Keep a table's fingerprint in its folder, where readers of the table do not look: the last thing written."""
    content.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/_manifest")


def verify_content(spark: SparkSession, path: str, by: Sequence[str] = ("year",)) -> DataFrame:
    """Hold a stored table against its manifest, partition by partition."""
    return compare_content(read_manifest(spark, path), fingerprint(spark.read.parquet(path), by), by)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file(spark, path)
    return bool(files.exists(target))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, if it is there."""
    remove_folder(spark, path)


def delete_source(spark: SparkSession, path: str) -> bool:
    """Delete one file (never a folder's contents) through the Hadoop file system of its scheme."""
    files, target = _file(spark, path)
    return bool(files.delete(target, False))


def is_file(spark: SparkSession, path: str) -> bool:
    files, target = _file(spark, path)
    return bool(files.exists(target)) and not files.getFileStatus(target).isDirectory()


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
