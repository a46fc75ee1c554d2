"""Postcode parsing and London classification as native column expressions.

The expressions stay in whole-stage code generation; no Python worker is started.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Every white-space character other than the plain space, as str.split() understands it.
_OTHER_SPACES = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Classification lists.
CENTRAL_AREAS = ["EC", "WC"]
CENTRAL_DISTRICTS = [
    "W1", "SW1", "NW1", "SE1", "E1", "N1", "WC1", "WC2", "EC1", "EC2", "EC3", "EC4",
    "EC1A", "EC1M", "EC1N", "EC1P", "EC1R", "EC1V", "EC1Y",
    "EC2A", "EC2M", "EC2N", "EC2P", "EC2R", "EC2V", "EC2Y",
    "EC3A", "EC3M", "EC3N", "EC3P", "EC3R", "EC3V",
    "EC4A", "EC4M", "EC4N", "EC4P", "EC4R", "EC4V", "EC4Y", "EC50",
]
GREATER_AREAS = [
    "EC", "WC", "E", "N", "NW", "SE", "SW", "W", "BR", "CR", "DA", "EN", "HA",
    "IG", "KT", "RM", "SM", "TW", "UB", "WD",
]
INNER_AREAS = ["EC", "WC", "N", "NW", "E", "SE", "SW", "W"]
OUTER_AREAS = ["HA", "UB", "EN", "KT", "TW", "BR", "RM"]
LONDON_ZONES = ["Central London", "Greater London"]


def area_from_district(district: Column | str, mode: str = "all_letters") -> Column:
    """The postcode area of a district code.

    ``all_letters`` keeps every letter (``SW1A`` gives ``SWA``), which is what published results
    were computed with; ``leading_letters`` keeps the true area (``SW``).
    """
    district = F.col(district) if isinstance(district, str) else district
    if mode == "all_letters":
        return F.regexp_replace(district, "[^A-Za-z]", "")
    if mode == "leading_letters":
        return F.regexp_extract(district, "^[A-Za-z]*", 0)
    raise ValueError(f"unknown area mode: {mode}")


def _plain_spaces(code: Column) -> Column:
    """Turn other white space into plain spaces; only the rare code that is not printable ASCII pays for it."""
    return F.when(code.rlike("[^ -~]"), F.translate(code, _OTHER_SPACES, " " * len(_OTHER_SPACES))).otherwise(code)


def _known(code: Column) -> Column:
    """Unknown for null, which also tells Catalyst that the code never is null: joins and groupings
    on it then push no null filter down to the scan, where it would parse every postcode again."""
    return F.coalesce(code, F.lit(UNKNOWN))


def with_district_and_sector(df: DataFrame, postcode: str = "postcode", strict_chars: bool = True) -> DataFrame:
    """Add ``postcode_district`` and ``postcode_sector``.

    The district is the outward code, with ``strict_chars`` only its letters and digits; null and
    blank postcodes give Unknown. The sector is the district, a hyphen and the first character of
    the inward code, or Unknown where there is no inward code. Each step is a column of its own,
    so that Catalyst evaluates it once per row, and the codes leave through a generator of one
    row: a filter on a code (a join infers many) then reads the code instead of being pushed
    below it, where it would parse every postcode again.
    """
    code = F.regexp_replace("_outward", "[^A-Za-z0-9]", "") if strict_chars else F.col("_outward")
    steps = (
        df.withColumn("_code", F.ltrim(_plain_spaces(F.col(postcode))))
        .withColumn("_outward", F.substring_index("_code", " ", 1))
        .withColumn(
            "_initial", F.substring(F.ltrim(F.substr("_code", F.length("_outward") + F.lit(1))), 1, 1)
        )
        .withColumn("_district", _known(F.when(F.length("_outward") > 0, code)))
    )
    sector = _known(F.when(F.length("_initial") > 0, F.concat("_district", F.lit("-"), "_initial")))
    codes = F.struct(F.col("_district").alias("postcode_district"), sector.alias("postcode_sector"))
    return steps.select(*df.columns, F.inline(F.array(codes)))


def with_postcode_parts(
    df: DataFrame, postcode: str = "postcode", strict_chars: bool = True, mode: str = "all_letters"
) -> DataFrame:
    """Add ``postcode_area``, ``postcode_district`` and ``postcode_sector``.

    The letters of the outward code are the letters of the district code, so the area needs no
    second look at the postcode.
    """
    return with_district_and_sector(df, postcode, strict_chars).withColumn(
        "postcode_area", area_from_district("postcode_district", mode)
    )


def london_zone(area: Column | str = "postcode_area", district: Column | str = "postcode_district") -> Column:
    """Central London, Greater London, Outside London, or Unknown where either code is null."""
    area = F.col(area) if isinstance(area, str) else area
    district = F.col(district) if isinstance(district, str) else district
    return (
        F.when(area.isNull() | district.isNull(), UNKNOWN)
        .when(area.isin(CENTRAL_AREAS) | district.isin(CENTRAL_DISTRICTS), "Central London")
        .when(area.isin(GREATER_AREAS), "Greater London")
        .otherwise("Outside London")
    )


def inner_outer_zone(area: Column | str = "postcode_area") -> Column:
    """The exploratory classification: Inner London, Outer London, Outside London, or Unknown."""
    area = F.col(area) if isinstance(area, str) else area
    return (
        F.when(area.isNull(), UNKNOWN)
        .when(area.isin(INNER_AREAS), "Inner London")
        .when(area.isin(OUTER_AREAS), "Outer London")
        .otherwise("Outside London")
    )
