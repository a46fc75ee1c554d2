"""Stand-ins for the engine's input tables, derived from the generic test tables.

Each view is a plain select list that runs unchanged on Spark and DuckDB, so queries and their
check SQL read the same input. Every view covers its whole base table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propstats.functions import geometry as geo

# Postcode areas of the fixtures, by position.
_AREAS = [
    "EC", "WC", "E", "N", "NW", "SE", "SW", "W", "BR", "CR", "DA", "EN", "HA",
    "IG", "KT", "RM", "SM", "TW", "UB", "WD", "M", "L", "B", "LS", "BT",
]


def _area(position: str) -> str:
    return f"split_part('{','.join(_AREAS)}', ',', CAST(1 + {position} AS INT))"


SALES = {
    "transaction_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
    "price": "100000 + CAST(floor(l_extendedprice * (1 + l_suppkey % 5) / 5) AS INT)",
    "date_transfer": "CAST(l_shipdate AS DATE)",
    "postcode": f"""CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE concat(
        {_area("l_suppkey % 25")},
        CAST(1 + l_partkey % 9 AS STRING),
        CASE WHEN l_partkey % 4 = 0 THEN 'A' ELSE '' END,
        CASE WHEN l_orderkey % 89 = 0 THEN '' ELSE concat(' ', CAST(1 + l_orderkey % 9 AS STRING), 'AA') END) END""",
    "property_type": "CASE l_partkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'S' WHEN 2 THEN 'T' WHEN 3 THEN 'F' ELSE 'O' END",
}

# A raw feed line per sale. Every 101st order has a price that is no number, every 103rd a short
# line, every 107th a date that is none, every 109th an empty quoted postcode.
RAW_LINE = """CASE
    WHEN l_orderkey % 103 = 0 THEN concat(transaction_id, ',', CAST(price AS STRING))
    ELSE concat(transaction_id, ',',
        CASE WHEN l_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(price AS STRING) END, ',',
        CASE WHEN l_orderkey % 107 = 0 THEN 'unknown' ELSE concat(CAST(date_transfer AS STRING), ' 00:00') END, ',"',
        CASE WHEN l_orderkey % 109 = 0 OR postcode IS NULL THEN '' ELSE postcode END, '",',
        property_type, ',N,F,', CAST(l_linenumber AS STRING), ',,"HIGH STREET, NORTH",,LONDON,CITY,LONDON,A,A')
    END"""

# Two monthly files of changes to the feed, as (which sales, id, price, date, status): new prices, deletions, sales moved by
# a year and new sales; then deletions of changed sales, deleted ones that come back, and sales both added and deleted.
_NEXT_YEAR = "concat(CAST(CAST(year(date_transfer) AS INT) + 1 AS STRING), '-06-15')"
CHANGES = [
    [
        ("l_orderkey % 50 = 0", "transaction_id", "price + 1000", "CAST(date_transfer AS STRING)", "C"),
        ("l_orderkey % 50 = 1", "transaction_id", "price", "CAST(date_transfer AS STRING)", "D"),
        ("l_orderkey % 50 = 2", "transaction_id", "price", _NEXT_YEAR, "C"),
        ("l_orderkey % 50 = 3 AND l_linenumber = 1", "concat('new-', transaction_id)", "price", "CAST(date_transfer AS STRING)", "A"),
    ],
    [
        ("l_orderkey % 50 = 0 AND l_linenumber = 1", "transaction_id", "price", "CAST(date_transfer AS STRING)", "D"),
        ("l_orderkey % 50 = 1 AND l_linenumber = 1", "transaction_id", "price + 5", "CAST(date_transfer AS STRING)", "C"),
        ("l_orderkey % 50 = 4 AND l_linenumber = 2", "transaction_id", "price", "CAST(date_transfer AS STRING)", "D"),
        ("l_orderkey % 50 = 4 AND l_linenumber = 2", "transaction_id", "price + 7", "CAST(date_transfer AS STRING)", "A"),
    ],
]

# Text dates as a lenient parser meets them: every 13th is an impossible day, every 17th no date.
DATE_TEXT = """CASE WHEN l_orderkey % 13 = 0 THEN '1999-02-30' WHEN l_orderkey % 17 = 0 THEN 'not known'
    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END"""

DISTRICT_BOXES = {
    "PostDist": f"concat({_area('n_nationkey')}, '1')",
    "x0": "CAST((n_nationkey % 5) * 100 AS DOUBLE)",
    "y0": "CAST(floor(n_nationkey / 5) * 100 AS DOUBLE)",
    "x1": "CAST((n_nationkey % 5) * 100 + 100 AS DOUBLE)",
    "y1": "CAST(floor(n_nationkey / 5) * 100 + 100 AS DOUBLE)",
}

_OTHER_MULTIPLIERS = {
    "Income": (19, 23),
    "Employment": (23, 29),
    "Education": (29, 37),
    "Health": (37, 41),
    "HousingBarriers": (41, 43),
    "Environment": (43, 19),
}

# Codes of two letter prefixes: the lowest code of a district is not the one with the lowest digits.
ZONE_CODE = "concat(CASE WHEN c_custkey % 3 = 0 THEN 'E' ELSE 'W' END, lpad(CAST(c_custkey AS STRING), 8, '0'))"
ZONE_NUMBER = "CAST(substring(LSOACode, 2) AS BIGINT)"

ZONE_BOXES = {
    "LSOACode": ZONE_CODE,
    "x0": "CAST((c_custkey * 37) % 500 AS DOUBLE)",
    "y0": "CAST((c_custkey * 91) % 500 AS DOUBLE)",
    "x1": "CAST((c_custkey * 37) % 500 + 2 + c_custkey % 11 AS DOUBLE)",
    "y1": "CAST((c_custkey * 91) % 500 + 2 + c_custkey % 11 AS DOUBLE)",
}

ZONE_FACTS = {
    "LSOACode": ZONE_CODE,
    "LADName": "concat('LAD', CAST(c_custkey % 7 AS STRING))",
    "TotalPopulation": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(1000 + c_custkey % 1000 AS INT) END",
    "DependentChildren": "CAST(c_custkey % 300 AS INT)",
    "Population60Plus": "CAST(c_custkey % 250 AS INT)",
    "WorkingAgePopulation": "CAST(c_custkey % 600 AS INT)",
    "OverallScore": "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) / 100 END",
    "OverallRank": "CAST((c_custkey * 13) % 1000 + 1 AS INT)",
    "CrimeScore": "CASE WHEN c_custkey % 30 = 7 THEN CAST('NaN' AS DOUBLE) ELSE CAST((c_custkey * 31) % 1000 AS DOUBLE) / 10 END",
    "CrimeRank": "CAST((c_custkey * 17) % 1000 + 1 AS INT)",
    **{
        key: value
        for name, (score, rank) in _OTHER_MULTIPLIERS.items()
        for key, value in {
            f"{name}Score": f"CAST((c_custkey * {score}) % 1000 AS DOUBLE) / 10",
            f"{name}Rank": f"CAST((c_custkey * {rank}) % 1000 + 1 AS INT)",
        }.items()
    },
}


# The headers of the published indicator file for the columns above, written out.
PUBLISHED_HEADERS = {
    "LSOACode": "LSOA code (2021)",
    "LADName": "Local Authority District name (2024)",
    "TotalPopulation": "Total population: mid 2022",
    "DependentChildren": "Dependent Children aged 0-15: mid 2022",
    "Population60Plus": "Older population aged 60 and over: mid 2022",
    "WorkingAgePopulation": "Working age population 18-66 (for use with Employment Deprivation Domain): mid 2022",
    "OverallScore": "Index of Multiple Deprivation (IMD) Score",
    "OverallRank": "Index of Multiple Deprivation (IMD) Rank (where 1 is most deprived)",
    "CrimeScore": "Crime Score",
    "CrimeRank": "Crime Rank (where 1 is most deprived)",
    "IncomeScore": "Income Score (rate)",
    "IncomeRank": "Income Rank (where 1 is most deprived)",
    "EmploymentScore": "Employment Score (rate)",
    "EmploymentRank": "Employment Rank (where 1 is most deprived)",
    "EducationScore": "Education, Skills and Training Score",
    "EducationRank": "Education, Skills and Training Rank (where 1 is most deprived)",
    "HealthScore": "Health Deprivation and Disability Score",
    "HealthRank": "Health Deprivation and Disability Rank (where 1 is most deprived)",
    "HousingBarriersScore": "Barriers to Housing and Services Score",
    "HousingBarriersRank": "Barriers to Housing and Services Rank (where 1 is most deprived)",
    "EnvironmentScore": "Living Environment Score",
    "EnvironmentRank": "Living Environment Rank (where 1 is most deprived)",
}


def select_list(view: dict[str, str]) -> str:
    return ", ".join(f'{expression} AS {name}' for name, expression in view.items())


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the five columns the statistics need."""
    return _read(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in SALES.items()])


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in SALES.items()]
    )
    return base.selectExpr(f"{RAW_LINE} AS value")


def change_lines(spark: SparkSession, sf_dir: str, month: int) -> DataFrame:
    """The lines of one of the monthly files."""
    base = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in SALES.items()])
    parts = []
    for which, key, price, date, status in CHANGES[month]:
        line = f"""concat({key}, ',', CAST({price} AS STRING), ',', {date}, ' 00:00,"', coalesce(postcode, ''), '",',
            property_type, ',N,F,', CAST(l_linenumber AS STRING), ',,"HIGH STREET, NORTH",,LONDON,CITY,LONDON,A,{status}')"""
        parts.append(base.where(which).selectExpr(f"{line} AS value"))
    return reduce(DataFrame.unionByName, parts)


def dated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(f"{DATE_TEXT} AS date_text")


def _corners() -> list[Column]:
    return [F.col(name) for name in ("x0", "y0", "x1", "y1")]


def _layer(df: DataFrame, geometry: Column) -> DataFrame:
    """A polygon layer as stored: geometry, bounds and reference system."""
    named = {"x0": "min_x", "y0": "min_y", "x1": "max_x", "y1": "max_y"}
    return df.withColumns({"geometry": geometry, "srid": F.lit(27700)}).withColumnsRenamed(named)


def _district_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", *[f"{e} AS {n}" for n, e in DISTRICT_BOXES.items()]
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square districts."""
    return _layer(_district_boxes(spark, sf_dir), geo.box(*_corners())).drop("n_nationkey")


def shaped_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same squares with, in turn, a hole in the middle, a notch from the top, or a gap between two parts."""
    x0, y0, x1, y1 = _corners()
    hole = geo.ring((x0 + 40, y0 + 40), (x0 + 40, y0 + 60), (x0 + 60, y0 + 60), (x0 + 60, y0 + 40))
    holed = F.array(F.array(geo.box_ring(x0, y0, x1, y1), hole))
    notched = F.array(
        F.array(
            geo.ring(
                (x0, y0), (x1, y0), (x1, y1), (x0 + 60, y1), (x0 + 60, y0 + 60), (x0 + 40, y0 + 60), (x0 + 40, y1), (x0, y1)
            )
        )
    )
    parted = F.array(F.array(geo.box_ring(x0, y0, x0 + 45, y1)), F.array(geo.box_ring(x0 + 55, y0, x1, y1)))
    kind = F.col("n_nationkey") % 3
    shape = F.when(kind == 0, holed).when(kind == 1, notched).otherwise(parted)
    return _layer(_district_boxes(spark, sf_dir), shape).drop("n_nationkey")


def detailed_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same squares with borders of about 2,000 points; the upper one is a saw whose teeth reach half a unit down."""
    side = "transform(sequence(0, 332), i -> named_struct('x', {x}, 'y', {y}))"
    sides = [
        side.format(x="x0 + i * 0.3", y="y0"),
        side.format(x="x1", y="y0 + i * 0.3"),
        "transform(sequence(0, 1000), i -> named_struct('x', x1 - i * 0.1, 'y', y1 - i % 2 * 0.5))",
        side.format(x="x0", y="y1 - i * 0.3"),
        "array(named_struct('x', x0, 'y', y0))",
    ]
    points = f"transform(concat({', '.join(sides)}), p -> named_struct('x', CAST(p.x AS DOUBLE), 'y', CAST(p.y AS DOUBLE)))"
    return _layer(_district_boxes(spark, sf_dir), F.array(F.array(F.expr(points)))).drop("n_nationkey")


def zone_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in ZONE_BOXES.items()])
    return _layer(boxes, geo.box(*_corners()))


def zone_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in ZONE_FACTS.items()])


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone polygons with their indicators, as one stored table."""
    both = {**ZONE_BOXES, **ZONE_FACTS}
    rows = _read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in both.items()])
    return _layer(rows, geo.box(*_corners()))


def flawed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with, in turn: no flaw, no closing point, a repeated point, a crossing, no area, too few points,
    a ring that touches itself, a spike, a good hole, a hole outside, a hole across the border, two overlapping parts,
    and a hole within a hole.
    """
    x0, y0, x1, y1 = _corners()
    good = geo.box_ring(x0, y0, x1, y1)
    kind = F.expr(ZONE_NUMBER) % 13
    w, h = x1 - x0, y1 - y0

    def inner(a: float, b: float) -> Column:
        """A square hole from share a to share b of the sides, clockwise."""
        return geo.ring((x0 + w * a, y0 + h * a), (x0 + w * a, y0 + h * b), (x0 + w * b, y0 + h * b), (x0 + w * b, y0 + h * a))

    middle = (x0 + w / 2, y0 + h / 2)
    eight = geo.ring((x0, y0), (x1, y0), middle, (x1, y1), (x0, y1), middle)
    spike = geo.ring((x0, y0), (x1, y0), (x1, y1), (x1, y1 + h), (x1, y1), (x0, y1))
    shape = (
        F.when(kind == 0, good)
        .when(kind == 1, F.slice(good, 1, 4))
        .when(kind == 2, F.concat(F.slice(good, 1, 2), F.slice(good, 2, 4)))
        .when(kind == 3, geo.ring((x0, y0), (x1, y1), (x1, y0), (x0, y1)))
        .when(kind == 4, geo.ring((x0, y0), ((x0 + x1) / 2, y0), (x1, y0)))
        .when(kind == 5, geo.ring((x0, y0), (x1, y1)))
        .when(kind == 6, eight)
        .when(kind == 7, spike)
    )
    holes = {8: [inner(0.25, 0.75)], 9: [inner(1.25, 1.75)], 10: [inner(0.5, 1.5)], 12: [inner(0.25, 0.75), inner(0.375, 0.625)]}
    geometry = F.when(shape.isNotNull(), F.array(F.array(shape)))
    for number, cut in holes.items():
        geometry = geometry.when(kind == number, F.array(F.array(good, *cut)))
    overlapping = geo.box_ring(x0 + w / 2, y0 + h / 2, x1 + w / 2, y1 + h / 2)
    geometry = geometry.otherwise(F.array(F.array(good), F.array(overlapping)))
    # Dealt before the shapes are made: the table may be one small file.
    boxes = _read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in ZONE_BOXES.items()]).repartition("LSOACode")
    # Bounds come from the geometry: some flaws reach beyond the square.
    return boxes.select("LSOACode", geometry.alias("geometry"), F.lit(27700).alias("srid"))


#: Where the nodes of the shift grid lie (first longitude and latitude, steps), and their shifts: it covers part of the zones.
SHIFT_GRID = (-0.1, 51.55, 0.1, 0.06)
SHIFT_NODES = {
    "col": "CAST(n_nationkey % 5 AS INT)",
    "row": "CAST(floor(n_nationkey / 5) AS INT)",
    "d_lon": "CASE WHEN n_nationkey = 18 THEN NULL ELSE CAST((n_nationkey * 37) % 11 - 5 AS DOUBLE) / 10000 END",
    "d_lat": "CAST((n_nationkey * 23) % 13 - 6 AS DOUBLE) / 20000",
}


def shift_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr(*[f"{e} AS {n}" for n, e in SHIFT_NODES.items()])


def cut_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with, in turn: a hole that touches the border twice, two holes that meet twice, a hole that touches once,
    a coordinate that is no number, an infinite one, two holes from border to border, and no flaw.
    """
    x0, y0, x1, y1 = _corners()
    w, h = x1 - x0, y1 - y0

    def at(a: float, b: float) -> tuple[Column, Column]:
        return x0 + w * a, y0 + h * b

    def holed(*holes: Column) -> Column:
        return F.array(F.array(geo.box_ring(x0, y0, x1, y1), *holes))

    def broken(value: str) -> Column:
        return F.array(F.array(geo.ring((x0, y0), (F.lit(value).cast("double"), y0), (x1, y1))))

    shapes = [
        holed(geo.ring(at(0, 0.5), at(0.5, 0.75), at(1, 0.5), at(0.5, 0.25))),
        holed(geo.ring(at(0.25, 0.5), at(0.5, 0.875), at(0.75, 0.5), at(0.5, 0.625)), geo.ring(at(0.25, 0.5), at(0.5, 0.125), at(0.75, 0.5), at(0.5, 0.375))),
        holed(geo.ring(at(0, 0.5), at(0.5, 0.75), at(0.5, 0.25))),
        broken("NaN"),
        broken("Infinity"),
        holed(geo.ring(at(0, 0.5), at(0.25, 0.75), at(0.5, 0.5), at(0.25, 0.25)), geo.ring(at(0.5, 0.5), at(0.75, 0.75), at(1, 0.5), at(0.75, 0.25))),
        holed(),
    ]
    kind, geometry = F.expr(ZONE_NUMBER) % len(shapes), F.when(F.lit(False), shapes[-1])
    for number, shape in enumerate(shapes):
        geometry = geometry.when(kind == number, shape)
    boxes = _read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in ZONE_BOXES.items()]).repartition("LSOACode")
    return boxes.select("LSOACode", geometry.alias("geometry"), F.lit(27700).alias("srid"))
