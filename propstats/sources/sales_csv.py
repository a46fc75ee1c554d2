"""Raw sale records: headerless CSV lines in, typed rows and malformed lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propstats.schema import SALE_SCHEMA

_CORRUPT = "_malformed_line"


def read_raw_sales(spark: SparkSession, path: str) -> DataFrame:
    """All records of a headerless CSV, with the text of malformed ones in ``_malformed_line``.

    Lines are read as text and parsed as a whole. A plain CSV scan parses only the columns a query
    asks for, so what counts as malformed there (and every row count) changes with the query, and
    only a cache of the whole file would settle it.
    """
    fields = [*SALE_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())]
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in fields)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_csv("value", schema, options).alias("record")).select("record.*")


def well_formed(raw: DataFrame) -> DataFrame:
    """Only the records that parse in full."""
    return raw.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def malformed(raw: DataFrame) -> DataFrame:
    """The text of the records that do not."""
    return raw.where(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("line"))


def record_counts(raw: DataFrame) -> DataFrame:
    """One row: lines read, well-formed ones and malformed ones."""
    return raw.agg(
        F.count(F.lit(1)).alias("raw_lines"),
        F.count_if(F.col(_CORRUPT).isNull()).alias("parsed"),
        F.count_if(F.col(_CORRUPT).isNotNull()).alias("malformed"),
    )
