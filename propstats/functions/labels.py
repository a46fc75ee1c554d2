"""Small value mappings and lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Property type codes and their names.
PROPERTY_TYPES = {
    "T": "Terraced",
    "S": "Semi-Detached",
    "D": "Detached",
    "F": "Flat",
    "O": "Other",
}


def map_values(column: Column | str, mapping: dict[str, str]) -> Column:
    """Look a value up in a literal mapping; a value without an entry gives null."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def property_type_name(column: Column | str = "property_type") -> Column:
    return map_values(column, PROPERTY_TYPES)


def lenient_date(column: Column | str) -> Column:
    """A date, or null where the text is none. Never raises under ANSI mode."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("date")


def year_start(column: Column | str = "year") -> Column:
    """The first day of a year, for time axes."""
    column = F.col(column) if isinstance(column, str) else column
    return F.make_date(column, F.lit(1), F.lit(1))


def has_space(column: Column | str = "postcode") -> Column:
    """The format rule for postcodes: outward and inward part are split by a space."""
    column = F.col(column) if isinstance(column, str) else column
    return column.contains(" ")


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round half up on the ninth decimal and then on ``digits``, so that binary noise cannot tip a tie.

    Values beyond 10 ** 15 have no decimals to speak of and stay as they are.
    """
    value = value.cast("double")
    rounded = F.round(F.when(F.abs(value) < 1e15, value).cast("decimal(28,9)"), digits).cast("double")
    return F.coalesce(rounded, value)


def guarded_percent(part: Column, total: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``total``, 0 where the total is not positive."""
    return F.when(total > 0, round_half_up(part * 100 / total, digits)).otherwise(F.lit(0.0))


def guarded_ratio(part: Column, total: Column, digits: int = 2) -> Column:
    """``part / total``, 0 where the total is not positive."""
    return F.when(total > 0, round_half_up(part / total, digits)).otherwise(F.lit(0.0))


def nan_to_null(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.nanvl(column, F.lit(None).cast("double"))
