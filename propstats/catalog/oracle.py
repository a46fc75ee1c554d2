"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from propstats.catalog import fixtures as fx
from propstats.schema import COMMON_KEYS, INDICATORS, LEVELS, POPULATION_COLUMNS


def _names(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


SALES = f"sales AS (SELECT {fx.select_list(fx.SALES)} FROM lineitem)"

# The classification lists, written out anew so that a slip in the engine's own lists shows.
ZONE_CASE = """CASE
    WHEN postcode_area IN ('EC', 'WC') OR postcode_district IN (
        'W1', 'SW1', 'NW1', 'SE1', 'E1', 'N1', 'WC1', 'WC2', 'EC1', 'EC2', 'EC3', 'EC4',
        'EC1A', 'EC1M', 'EC1N', 'EC1P', 'EC1R', 'EC1V', 'EC1Y', 'EC2A', 'EC2M', 'EC2N', 'EC2P', 'EC2R', 'EC2V', 'EC2Y',
        'EC3A', 'EC3M', 'EC3N', 'EC3P', 'EC3R', 'EC3V', 'EC4A', 'EC4M', 'EC4N', 'EC4P', 'EC4R', 'EC4V', 'EC4Y', 'EC50')
        THEN 'Central London'
    WHEN postcode_area IN ('EC', 'WC', 'E', 'N', 'NW', 'SE', 'SW', 'W', 'BR', 'CR', 'DA', 'EN', 'HA',
        'IG', 'KT', 'RM', 'SM', 'TW', 'UB', 'WD') THEN 'Greater London'
    ELSE 'Outside London' END"""

# Sales with postcode parts, zone and year.
PLACED = f"""{SALES},
coded AS (
    SELECT *, split_part(trim(postcode), ' ', 1) AS outward, split_part(trim(postcode), ' ', 2) AS inward
    FROM sales WHERE postcode IS NOT NULL),
split AS (
    SELECT * EXCLUDE (outward, inward), regexp_replace(outward, '[^A-Za-z]', '', 'g') AS postcode_area,
        regexp_replace(outward, '[^A-Za-z0-9]', '', 'g') AS postcode_district,
        CASE WHEN inward <> '' THEN regexp_replace(outward, '[^A-Za-z0-9]', '', 'g') || '-' || left(inward, 1)
            ELSE 'Unknown' END AS postcode_sector
    FROM coded),
placed AS (SELECT *, {ZONE_CASE} AS "is_london?", CAST(year(date_transfer) AS INTEGER) AS year FROM split)"""


def _statistics(source: str, keys: list[str], name: str) -> str:
    """CTEs ``{name}``: price statistics of ``source`` per group; moments in two passes."""
    on = " AND ".join(f'a."{k}" IS NOT DISTINCT FROM b."{k}"' for k in keys)
    k = _names(keys)
    return f"""
{name}_mean AS (SELECT {k}, avg(price) AS mu FROM {source} GROUP BY {k}),
{name}_off AS (SELECT a.*, a.price - b.mu AS off, b.mu FROM {source} a JOIN {name}_mean b ON {on}),
{name}_raw AS (
    SELECT {k}, count(*) AS num_transactions, max(mu) AS mu, count(price) AS n,
        sum(off * off) AS m2, sum(off * off * off) AS m3, sum(off * off * off * off) AS m4,
        quantile_disc(price, 0.25) AS p25, quantile_disc(price, 0.5) AS p50, quantile_disc(price, 0.75) AS p75,
        quantile_disc(price, 0.9) AS p90, quantile_disc(price, 0.95) AS p95
    FROM {name}_off GROUP BY {k}),
{name}_base AS (
    SELECT {k}, num_transactions, round(mu, 1) AS avg_price,
        CASE WHEN n > 1 THEN round(sqrt(m2 / (n - 1)), 1) END AS stddev_price,
        p25 AS "25th_percentile_price", p50 AS median_price, p75 AS "75th_percentile_price",
        p90 AS "90th_percentile_price", p95 AS "95th_percentile_price",
        CASE WHEN m2 > 0 THEN round(sqrt(n) * m3 / sqrt(m2 * m2 * m2), 2) + 0.0 END AS skewness_price,
        CASE WHEN m2 > 0 THEN round(n * m4 / (m2 * m2) - 3, 2) + 0.0 END AS kurtosis_price
    FROM {name}_raw),
{name} AS (
    SELECT *, round(stddev_price / nullif(avg_price, 0) * 100, 1) AS coef_var,
        "75th_percentile_price" - "25th_percentile_price" AS iqr,
        round(median_price - avg_price, 1) + 0.0 AS median_mean_diff,
        round(abs(round(median_price - avg_price, 1) / nullif(median_price, 0)) * 100, 1) AS median_mean_diff_pct,
        round(CAST("75th_percentile_price" - "25th_percentile_price" AS DOUBLE) / nullif(median_price, 0) * 100, 1)
            AS iqr_pct
    FROM {name}_base)"""


def _trends(source: str, series: list[str], keys: list[str], name: str, thresholds: str) -> str:
    """CTE ``{name}``: yearly change, rolling means, zero-fill and quality flag."""
    part = _names(series)
    zero = [
        "avg_price", "stddev_price", "skewness_price", "kurtosis_price", "coef_var", "median_mean_diff",
        "median_mean_diff_pct", "iqr_pct", "lag_median_price", "median_pct_change_1_year",
        "roll_median_pct_2_year", "roll_median_pct_5_year",
    ]
    plain = [
        "num_transactions", "25th_percentile_price", "median_price", "75th_percentile_price",
        "90th_percentile_price", "95th_percentile_price", "iqr",
    ]
    filled = ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in zero)
    return f"""
{name}_lag AS (
    SELECT *, lag(median_price) OVER (PARTITION BY {part} ORDER BY year) AS lag_median_price FROM {source}),
{name}_change AS (
    SELECT *, (CAST(median_price AS DOUBLE) - lag_median_price) * 100 / nullif(lag_median_price, 0) AS change
    FROM {name}_lag),
{name}_roll AS (
    SELECT * EXCLUDE (change), round(change, 1) + 0.0 AS median_pct_change_1_year,
        round(avg(change) OVER (PARTITION BY {part} ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 1) + 0.0
            AS roll_median_pct_2_year,
        round(avg(change) OVER (PARTITION BY {part} ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 1) + 0.0
            AS roll_median_pct_5_year
    FROM {name}_change),
{name}_filled AS (SELECT {_names(keys)}, {_names(plain)}, {filled} FROM {name}_roll),
{name} AS (SELECT *, {thresholds} AS is_good_sample FROM {name}_filled)"""


GOLD_FLAG = "num_transactions >= 30 AND coef_var <= 50 AND median_mean_diff_pct <= 10 AND iqr_pct <= 25"

_SERIES = {
    "area": ["postcode_area", "is_london?", "property_type"],
    "district": ["postcode_district", "is_london?", "property_type"],
    "sector": ["postcode_district", "postcode_sector", "is_london?", "property_type"],
}


def _level_stats(level: str) -> str:
    return f"{PLACED}, {_statistics('placed', LEVELS[level] + COMMON_KEYS, 'stats')}"


def level_trends(level: str) -> str:
    """CTEs up to ``trends``: the gold table of a level."""
    return f"{_level_stats(level)}, {_trends('stats', _SERIES[level], LEVELS[level] + COMMON_KEYS, 'trends', GOLD_FLAG)}"


def _multi_level() -> str:
    parts = [PLACED]
    selects = []
    for level, codes in LEVELS.items():
        parts.append(_statistics("placed", codes + COMMON_KEYS, f"s_{level}"))
        shown = ", ".join(f'"{c}"' if c in codes else f'CAST(NULL AS VARCHAR) AS "{c}"' for c in LEVELS["sector"])
        selects.append(f"SELECT '{level}' AS level, {shown}, * EXCLUDE ({_names(codes)}) FROM s_{level}")
    return f"WITH {', '.join(parts)} {' UNION ALL BY NAME '.join(selects)}"


LATEST, SINCE, LOW = 2000, 1999, 5
_SELECTED = "('E1', 'N1', 'SW1', 'BR1', 'M1')"
_SELECTED_TRENDS = "('E4', 'N7', 'SW2A', 'BR5', 'M9A')"


def _round(value: str, digits: int = 2) -> str:
    """Round half up on the decimal text of a number."""
    return f"CAST(round(CAST({value} AS DECIMAL(28, 9)), {digits}) AS DOUBLE)"


DISTRICTS = f"districts AS (SELECT {fx.select_list(fx.DISTRICT_BOXES)} FROM nation)"
# Scores that are NaN are missing.
NAN_TO_NULL = "REPLACE (CASE WHEN isnan(CrimeScore) THEN NULL ELSE CrimeScore END AS CrimeScore)"
ZONES = f"""zones AS (SELECT * {NAN_TO_NULL} FROM (SELECT {fx.select_list({**fx.ZONE_BOXES, **fx.ZONE_FACTS})} FROM customer))"""
FACTS = f"SELECT * {NAN_TO_NULL} FROM (SELECT {fx.select_list(fx.ZONE_FACTS)} FROM customer)"
INSIDE = "z.x0 >= d.x0 AND z.y0 >= d.y0 AND z.x1 <= d.x1 AND z.y1 <= d.y1"
PAIRS = f"pairs AS (SELECT z.*, d.PostDist FROM zones z JOIN districts d ON {INSIDE})"


def _socio() -> str:
    parts = []
    for name in INDICATORS:
        score, rank = f'"{name}Score"', f'"{name}Rank"'
        parts += [
            f'{_round(f"CAST(sum(CAST({score} AS DECIMAL(28, 8))) AS DOUBLE) / count({score})")} AS "{name}Avg"',
            f'{_round(f"median({score})")} AS "{name}Median"',
            f'{_round(f"min({score})")} AS "{name}Min"',
            f'{_round(f"max({score})")} AS "{name}Max"',
            f'{_round(f"avg({rank})")} AS "{name}RankAvg"',
        ]
    sums = ", ".join(f'CAST(coalesce(sum("{c}"), 0) AS BIGINT) AS "{c}"' for c in POPULATION_COLUMNS)
    percents = ", ".join(
        f'CASE WHEN TotalPopulation > 0 THEN {_round(f"{c} * 100.0::DOUBLE / TotalPopulation")} ELSE 0 END AS "{c}%"'
        for c in POPULATION_COLUMNS[1:]
    )
    return f"""rolled AS (
        SELECT PostDist, arg_min(LADName, LSOACode) AS AreaName, count(*) AS CountLowLevelAreas, {sums}, {', '.join(parts)}
        FROM pairs GROUP BY PostDist),
    socio AS (
        SELECT r.*, 27700 AS srid, (d.x1 - d.x0) * (d.y1 - d.y0) / 1000000 AS AreaKm2, {percents},
            CASE WHEN (d.x1 - d.x0) * (d.y1 - d.y0) > 0
                THEN {_round("TotalPopulation / ((d.x1 - d.x0) * (d.y1 - d.y0) / 1000000)")} ELSE 0 END AS PopulationDensity
        FROM rolled r JOIN districts d USING (PostDist))"""


_FLAT_SQL = f"flats AS (SELECT * FROM trends WHERE property_type = 'F' AND year <= {LATEST})"
_KEPT = f"""kept AS (SELECT * FROM flats f WHERE NOT EXISTS (
    SELECT 1 FROM flats b WHERE b.postcode_district = f.postcode_district
        AND b.num_transactions <= {LOW} AND b.year >= {SINCE}))"""
_TYPE_NAME = """CASE property_type WHEN 'T' THEN 'Terraced' WHEN 'S' THEN 'Semi-Detached' WHEN 'D' THEN 'Detached'
    WHEN 'F' THEN 'Flat' WHEN 'O' THEN 'Other' END"""


def _type_counts(condition: str) -> str:
    return f"""WITH {PLACED} SELECT postcode_district, {_TYPE_NAME} AS property_type, count(*) AS num_transactions
        FROM placed WHERE property_type IN ('T', 'S', 'D', 'F', 'O') AND {condition} GROUP BY 1, 2"""


_LONDON = """"is_london?" IN ('Central London', 'Greater London')"""
_CLEAN = """(l_orderkey % 103 <> 0 AND l_orderkey % 101 <> 0 AND l_orderkey % 107 <> 0)"""


def _marts() -> str:
    """Every CTE up to the joined district table and its London flats."""
    return f"""WITH {level_trends('district')}, {DISTRICTS}, {ZONES}, {PAIRS}, {_socio()},
    joined AS (SELECT t.*, s.* FROM trends t JOIN socio s ON t.postcode_district = s.PostDist),
    london AS (SELECT * FROM joined WHERE {_LONDON}),
    london_flats AS (SELECT * FROM london WHERE property_type = 'F')"""


def _pascal(column: str) -> str:
    if "_" not in column:
        return column[0].upper() + column[1:]
    return "".join(part.title() for part in column.split("_"))


def _long(pairs: dict[str, str], first: str, second: str, tail: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {first}, {v} AS {second} {tail}" for k, v in pairs.items())


class _Projection:
    """The published ellipsoids, National Grid series and datum shift, written out anew."""

    AIRY_A, AIRY_B = 6377563.396, 6356256.909
    AIRY_E2 = 1 - 6356256.909**2 / 6377563.396**2
    SCALE = 0.9996012717
    LAT0, LON0 = 0.8552113334772214, -0.03490658503988659
    EAST0, NORTH0 = 400000.0, -100000.0
    WGS_A = 6378137.0
    WGS_E2 = 1 - 6356752.3141**2 / 6378137.0**2
    SHIFT = (446.448, -125.157, 542.060)
    SHIFT_SCALE = -20.4894e-6
    TURN = (7.281901490265231e-07, 1.1974897923405538e-06, 4.082616008623402e-06)
    N = (6377563.396 - 6356256.909) / (6377563.396 + 6356256.909)
    ARC = (1 + N + 1.25 * N**2 + 1.25 * N**3, 3 * N + 3 * N**2 + 2.625 * N**3, 1.875 * N**2 + 1.875 * N**3, 35 / 24 * N**3)
    ITERATIONS = 5


def _by_grid() -> str:
    """Points moved by the four nodes around them, and by the published series where one of these is missing."""
    lon0, lat0, step_lon, step_lat = fx.SHIFT_GRID

    def between(name: str) -> str:
        return f"(a.{name} * (1 - fu) + b.{name} * fu) * (1 - fv) + (c.{name} * (1 - fu) + d.{name} * fu) * fv"

    points = "SELECT LSOACode, 0 AS place, x0 AS px, y0 AS py FROM zones UNION ALL SELECT LSOACode, 1, x1, y1 FROM zones"
    return f"""{_reprojection(points, "LSOACode, place", True)},
        nodes AS (SELECT {fx.select_list(fx.SHIFT_NODES)} FROM nation),
        known AS (SELECT * FROM nodes WHERE d_lon IS NOT NULL),
        placed AS (SELECT LSOACode, place, degrees(lon) AS x, degrees(lat) AS y, (degrees(lon) - {lon0!r}) / {step_lon!r} AS u,
            (degrees(lat) - {lat0!r}) / {step_lat!r} AS v FROM q3),
        inside AS (SELECT p.*, floor(u) AS cu, floor(v) AS cv, u - floor(u) AS fu, v - floor(v) AS fv FROM placed p),
        moved AS (SELECT LSOACode, place, x + {between('d_lon')} AS lon, y + {between('d_lat')} AS lat FROM inside
            JOIN known a ON a.col = cu AND a.row = cv JOIN known b ON b.col = cu + 1 AND b.row = cv
            JOIN known c ON c.col = cu AND c.row = cv + 1 JOIN known d ON d.col = cu + 1 AND d.row = cv + 1)
        SELECT LSOACode, place::INTEGER AS place, round(coalesce(m.lon, degrees(atan2(y, x))), 7) AS lon, round(coalesce(m.lat, degrees(r.lat)), 7) AS lat
        FROM r{_Projection.ITERATIONS} r LEFT JOIN moved m USING (LSOACode, place)"""


def _reprojection(points: str = "SELECT LSOACode, x0 AS px, y0 AS py FROM zones", key: str = "LSOACode", steps_only: bool = False) -> str:
    """The published series step by step, one CTE per step."""
    p = _Projection
    arc = p.ARC

    def meridian(lat: str) -> str:
        d, s = f"({lat} - {p.LAT0!r})", f"({lat} + {p.LAT0!r})"
        return (
            f"{p.AIRY_B * p.SCALE!r} * ({arc[0]!r} * {d} - {arc[1]!r} * sin({d}) * cos({s}) "
            f"+ {arc[2]!r} * sin({d} * 2) * cos({s} * 2) - {arc[3]!r} * sin({d} * 3) * cos({s} * 3))"
        )

    af = repr(p.AIRY_A * p.SCALE)
    steps = [
        f"""s0 AS (SELECT {key}, CAST(530000 + px * 100 AS DOUBLE) - {p.EAST0!r} AS e,
            CAST(180000 + py * 100 AS DOUBLE) - {p.NORTH0!r} AS n FROM ({points}))""",
        f"p0 AS (SELECT *, n / {af} + {p.LAT0!r} AS lat FROM s0)",
    ]
    for i in range(1, p.ITERATIONS + 1):
        steps.append(f"p{i} AS (SELECT * EXCLUDE (lat), lat + (n - {meridian('lat')}) / {af} AS lat FROM p{i - 1})")
    last = f"p{p.ITERATIONS}"
    steps += [
        f"q1 AS (SELECT *, tan(lat) AS t, 1 / cos(lat) AS sec, 1 - {p.AIRY_E2!r} * sin(lat) * sin(lat) AS w FROM {last})",
        f"q2 AS (SELECT *, {af} / sqrt(w) AS nu, {p.AIRY_A * p.SCALE * (1 - p.AIRY_E2)!r} / (w * sqrt(w)) AS rho FROM q1)",
        f"q3 AS (SELECT {key}, "
        + """
            lat - t / (2 * rho * nu) * e**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + (nu / rho - 1) - 9 * t**2 * (nu / rho - 1)) * e**4
                - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * e**6 AS lat,
            """
        + f"""{p.LON0!r} + sec / nu * e - sec / (6 * nu**3) * (nu / rho + 2 * t**2) * e**3
                + sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) * e**5
                - sec / (5040 * nu**7) * (61 + 662 * t**2 + 1320 * t**4 + 720 * t**6) * e**7 AS lon FROM q2)""",
        f"q4 AS (SELECT *, {p.AIRY_A!r} / sqrt(1 - {p.AIRY_E2!r} * sin(lat)**2) AS v FROM q3)",
        f"""q5 AS (SELECT {key}, v * cos(lat) * cos(lon) AS x, v * cos(lat) * sin(lon) AS y,
            v * {1 - p.AIRY_E2!r} * sin(lat) AS z FROM q4)""",
        f"""q6 AS (SELECT {key},
            {p.SHIFT[0]!r} + {1 + p.SHIFT_SCALE!r} * x - {p.TURN[2]!r} * y + {p.TURN[1]!r} * z AS x,
            {p.SHIFT[1]!r} + {p.TURN[2]!r} * x + {1 + p.SHIFT_SCALE!r} * y - {p.TURN[0]!r} * z AS y,
            {p.SHIFT[2]!r} - {p.TURN[1]!r} * x + {p.TURN[0]!r} * y + {1 + p.SHIFT_SCALE!r} * z AS z FROM q5)""",
        f"r0 AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * {1 - p.WGS_E2!r}) AS lat FROM q6)",
    ]
    for i in range(1, p.ITERATIONS + 1):
        steps.append(
            f"""r{i} AS (SELECT * EXCLUDE (lat), atan2(z + {p.WGS_E2 * p.WGS_A!r} * sin(lat)
                / sqrt(1 - {p.WGS_E2!r} * sin(lat)**2), r) AS lat FROM r{i - 1})"""
        )
    if steps_only:
        return f"WITH {ZONES}, {', '.join(steps)}"
    return f"""WITH {ZONES}, {', '.join(steps)} SELECT {key}, round(degrees(atan2(y, x)), 7) AS lon,
        round(degrees(lat), 7) AS lat FROM r{p.ITERATIONS}"""


def _shapes() -> str:
    """Containment in squares with a hole, a notch open to the top, or a gap between two parts."""
    return f"""WITH {ZONES},
    squares AS (SELECT n_nationkey % 3 AS kind, {fx.select_list(fx.DISTRICT_BOXES)} FROM nation)
    SELECT LSOACode, PostDist FROM zones z JOIN squares d ON {INSIDE} AND CASE kind
        WHEN 0 THEN NOT (z.x0 < d.x0 + 60 AND z.x1 > d.x0 + 40 AND z.y0 < d.y0 + 60 AND z.y1 > d.y0 + 40)
        WHEN 1 THEN NOT (z.x0 < d.x0 + 60 AND z.x1 > d.x0 + 40 AND z.y1 > d.y0 + 60)
        ELSE z.x1 <= d.x0 + 45 OR z.x0 >= d.x0 + 55 END"""


def _bad_numbers() -> str:
    """Numbering per area: compare each district number with the one before it."""
    return f"""WITH {PLACED},
    codes AS (SELECT DISTINCT postcode_district FROM placed),
    numbered AS (
        SELECT regexp_replace(postcode_district, '[^A-Za-z]', '', 'g') AS postcode_area, postcode_district,
            TRY_CAST(regexp_replace(postcode_district, '[^0-9]', '', 'g') AS BIGINT) AS num FROM codes),
    steps AS (
        SELECT *, lag(num) OVER (PARTITION BY postcode_area ORDER BY num, postcode_district) AS prev,
            min(num) OVER (PARTITION BY postcode_area) AS first_num FROM numbered WHERE num IS NOT NULL),
    flags AS (
        SELECT postcode_area, string_agg(CAST(num AS VARCHAR), ',' ORDER BY num) AS numbers,
            min(first_num) NOT IN (0, 1) AS bad_start,
            bool_or(num <> first_num AND num <> prev + 1) AS has_gap
        FROM steps GROUP BY postcode_area)
    SELECT n.postcode_area, count(*) AS num_districts, coalesce(any_value(f.numbers), '') AS numbers,
        count(num) = 0 AS no_numbers, coalesce(bool_or(f.bad_start), false) AS bad_start,
        coalesce(bool_or(f.has_gap), false) AS has_gap
    FROM numbered n LEFT JOIN flags f USING (postcode_area) GROUP BY n.postcode_area"""


def _pass_rate() -> str:
    sql = []
    for level in LEVELS:
        sql.append(
            f"""SELECT * FROM (WITH {level_trends(level)} SELECT '{level}' AS level,
            count(*) FILTER (WHERE is_good_sample) AS good_samples, count(*) AS total_samples,
            {_round("count(*) FILTER (WHERE is_good_sample) * 100.0::DOUBLE / count(*)")} AS pass_rate_pct FROM trends)"""
        )
    return " UNION ALL ".join(sql)


_STATIC = [
    "PostDist", "srid", "AreaName", "CountLowLevelAreas", "AreaKm2", *POPULATION_COLUMNS,
    *[f"{c}%" for c in POPULATION_COLUMNS[1:]], "PopulationDensity",
    *[f"{name}{kind}" for name in INDICATORS for kind in ("Avg", "RankAvg")],
]
_SERIES_MART = [
    "postcode_area", "postcode_district", "PostDist", "is_london?", "property_type", "year",
    "num_transactions", "avg_price", "stddev_price", "25th_percentile_price", "median_price",
    "75th_percentile_price", "90th_percentile_price", "95th_percentile_price", "skewness_price",
    "kurtosis_price", "coef_var", "iqr", "median_mean_diff", "median_mean_diff_pct", "iqr_pct",
    "lag_median_price", "median_pct_change_1_year", "roll_median_pct_2_year", "roll_median_pct_5_year",
    "is_good_sample",
]


def _monthly(sales_raw: str) -> str:
    """The feed after its monthly files: of each sale's records the last, deletions last of a month."""
    records = [
        f"""SELECT {month} AS month, {dict(A=0, C=1, D=2)[status]} AS place, {key} AS transaction_id, {price} AS price,
            CAST({date} AS DATE) AS date_transfer, postcode, property_type, '{status}' AS record_status FROM s WHERE {which}"""
        for month, file in enumerate(fx.CHANGES)
        for which, key, price, date, status in file
    ]
    return f"""WITH s AS ({sales_raw}), records AS ({' UNION ALL '.join(records)}),
        base AS (SELECT transaction_id, price, date_transfer, CASE WHEN l_orderkey % 109 = 0 THEN NULL ELSE postcode END AS postcode,
            property_type, 'A' AS record_status FROM s WHERE {_CLEAN} AND transaction_id NOT IN (SELECT transaction_id FROM records)),
        last AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY month DESC, place DESC, price DESC, date_transfer DESC,
            postcode DESC NULLS LAST, property_type DESC) = 1)
        SELECT *, CAST(year(date_transfer) AS INTEGER) AS year FROM (SELECT * FROM base
            UNION ALL SELECT * EXCLUDE (month, place) FROM last WHERE record_status <> 'D')"""


def _common(a: str, b: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """The area that two rectangles share."""
    wide = f"greatest(least({a}.x1, {b}.{x1}) - greatest({a}.x0, {b}.{x0}), 0)"
    return f"({wide} * greatest(least({a}.y1, {b}.{y1}) - greatest({a}.y0, {b}.{y0}), 0))"


_SHARED = f"""sizes AS (SELECT LSOACode, PostDist, {_common('z', 'd', 'x0', 'y0', 'x1', 'y1')} AS size FROM zones z, districts d),
    shared AS (SELECT * FROM sizes WHERE size > 0)"""


def oracle_sql() -> dict[str, str]:
    """One SQL text per registered query."""
    district_trends = level_trends("district")
    marts = _marts()
    series = ", ".join(f'f."{c}" AS "{_pascal(c)}"' for c in _SERIES_MART if c != "PostDist")
    static = ", ".join(f's."{c}" AS "{_pascal(c)}"' for c in _STATIC if c != "PostDist")
    inner_outer = """CASE WHEN postcode_area IN ('EC', 'WC', 'N', 'NW', 'E', 'SE', 'SW', 'W') THEN 'Inner London'
        WHEN postcode_area IN ('HA', 'UB', 'EN', 'KT', 'TW', 'BR', 'RM') THEN 'Outer London' ELSE 'Outside London' END"""
    sales_raw = f"""SELECT l_orderkey, l_linenumber, {fx.select_list(fx.SALES)} FROM lineitem"""
    flaw = "CAST(substring(LSOACode, 2) AS BIGINT) % 13"
    cut = "CAST(substring(LSOACode, 2) AS BIGINT) % 7"
    flaws = """WHEN 3 THEN 'Self-intersection' WHEN 4 THEN 'Zero area' WHEN 5 THEN 'Too few points' WHEN 6 THEN 'Self-intersection'
        WHEN 7 THEN 'Self-intersection' WHEN 9 THEN 'Hole lies outside shell' WHEN 10 THEN 'Rings cross'
        WHEN 11 THEN 'Overlapping parts' WHEN 12 THEN 'Nested holes' ELSE 'Valid'"""
    return {
        "area_price_stats": f"WITH {_level_stats('area')} SELECT * FROM stats",
        "area_price_trends": f"WITH {level_trends('area')} SELECT * FROM trends",
        "district_price_trends": f"WITH {district_trends} SELECT * FROM trends",
        "sector_price_trends": f"WITH {level_trends('sector')} SELECT * FROM trends",
        "multi_level_stats": _multi_level(),
        "sketch_counts": f"""WITH {PLACED} SELECT CASE WHEN year < {SINCE} THEN 'early' ELSE 'late' END AS span, postcode_district,
            property_type, count(*) AS num_transactions, count(price) AS num_sketched FROM placed GROUP BY 1, 2, 3""",
        "sketch_rank_error": f"""WITH {PLACED}, g AS ({' UNION ALL '.join(
            f"SELECT DISTINCT '{level}' AS level, postcode_{level} AS code, property_type FROM placed" for level in LEVELS)})
            SELECT level, p::DOUBLE AS percentile, count(*) AS groups, true AS within
            FROM g, (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95]) AS p) GROUP BY ALL""",
        "quality_pass_rate": _pass_rate(),
        "postcode_parts": f"""WITH {PLACED} SELECT transaction_id, postcode, postcode_area, postcode_district,
            postcode_sector FROM placed""",
        "postcode_parts_raw": f"""WITH {SALES} SELECT transaction_id, postcode,
            regexp_replace(split_part(postcode, ' ', 1), '[^A-Za-z]', '', 'g') AS postcode_area,
            split_part(postcode, ' ', 1) AS postcode_district,
            CASE WHEN split_part(postcode, ' ', 2) <> ''
                THEN split_part(postcode, ' ', 1) || '-' || left(split_part(postcode, ' ', 2), 1)
                ELSE 'Unknown' END AS postcode_sector
            FROM sales WHERE postcode IS NOT NULL""",
        "zone_counts": f'WITH {PLACED} SELECT "is_london?", count(*) AS num_transactions FROM placed GROUP BY 1',
        "zone_counts_inner_outer": f"""WITH {PLACED} SELECT {inner_outer} AS "is_london?",
            count(*) AS num_transactions FROM placed GROUP BY 1""",
        "class_samples": f"""WITH {PLACED} SELECT "is_london?", transaction_id, postcode, price FROM placed
            WHERE substring(md5(transaction_id), 1, 8) < '{round(0.01 * 16**8):08x}'
            QUALIFY row_number() OVER (PARTITION BY "is_london?" ORDER BY md5(transaction_id), transaction_id) <= 100""",
        "ingest_csv_roundtrip": f"""WITH s AS ({sales_raw}) SELECT transaction_id, price, date_transfer,
            CASE WHEN l_orderkey % 109 = 0 THEN NULL ELSE postcode END AS postcode, property_type,
            'N' AS old_new, 'F' AS duration, CAST(l_linenumber AS VARCHAR) AS paon, CAST(NULL AS VARCHAR) AS saon,
            'HIGH STREET, NORTH' AS street, CAST(NULL AS VARCHAR) AS locality, 'LONDON' AS town_city,
            'CITY' AS district, 'LONDON' AS county, 'A' AS ppd_category, 'A' AS record_status,
            CAST(year(date_transfer) AS INTEGER) AS year FROM s WHERE {_CLEAN}""",
        "ingest_reconcile": _long(
            {
                "raw_lines": "count(*)",
                "parsed": f"count(*) FILTER (WHERE {_CLEAN})",
                "malformed": f"count(*) FILTER (WHERE NOT {_CLEAN})",
                "written": f"count(*) FILTER (WHERE {_CLEAN})",
            },
            "step",
            "num_rows",
            "FROM lineitem",
        ),
        "ingest_verified": f"""WITH s AS ({sales_raw}), y AS (SELECT CAST(year(date_transfer) AS INTEGER) AS year, count(*) AS n,
                bool_or(l_linenumber = 1) AS altered FROM s WHERE {_CLEAN} GROUP BY 1)
            SELECT year, n AS expected_rows, n AS written_rows, true AS matches, 'stored' AS copy FROM y
            UNION ALL SELECT year, n, n, NOT altered, 'altered' FROM y""",
        "monthly_changes": _monthly(sales_raw),
        "silver_partition_counts": f"""WITH {SALES}, y AS (
            SELECT CAST(year(date_transfer) AS INTEGER) AS year, count(*) AS num_transactions FROM sales GROUP BY 1)
            SELECT *, CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS from_first,
                CAST(row_number() OVER (ORDER BY year DESC) AS INTEGER) AS from_last FROM y""",
        "qa_null_counts": f"""WITH {SALES} SELECT column_name, null_count, {_round("null_count * 100.0::DOUBLE / n")} AS null_pct
            FROM ({_long({c: f"count(*) - count({c})" for c in ["price", "date_transfer", "postcode", "property_type"]},
                         "column_name", "null_count", ", count(*) AS n FROM sales")})""",
        "qa_price_summary": f"""WITH {SALES} SELECT summary, round(value, 4) AS value FROM ({_long(
            {"count": "CAST(count(price) AS DOUBLE)", "mean": "avg(price)", "stddev": "stddev_samp(price)",
             "min": "CAST(min(price) AS DOUBLE)", "max": "CAST(max(price) AS DOUBLE)"},
            "summary", "value", "FROM sales")})""",
        "qa_type_frequency": f"""WITH {SALES}, c AS (SELECT property_type, count(*) AS num_transactions FROM sales GROUP BY 1)
            SELECT *, CAST(row_number() OVER (ORDER BY num_transactions DESC, property_type) AS INTEGER) AS position FROM c
            QUALIFY row_number() OVER (ORDER BY num_transactions DESC, property_type) <= 10""",
        "qa_ranges": f"""WITH {SALES} SELECT min(date_transfer) AS min_date, max(date_transfer) AS max_date,
            min(price) AS min_price, max(price) AS max_price, median(price) AS median_price FROM sales""",
        "qa_bad_postcodes": f"""WITH {SALES} SELECT postcode, count(*) AS num_transactions FROM sales
            WHERE postcode IS NOT NULL AND NOT contains(postcode, ' ') GROUP BY 1""",
        "qa_invalid_dates": f"""WITH d AS (SELECT {fx.DATE_TEXT} AS t FROM lineitem) SELECT count(*) AS num_rows,
            count(*) FILTER (WHERE TRY_CAST(t AS DATE) IS NULL) AS invalid_dates, min(TRY_CAST(t AS DATE)) AS min_date,
            max(TRY_CAST(t AS DATE)) AS max_date, min(t) AS min_text, max(t) AS max_text FROM d""",
        "district_numbering": _bad_numbers(),
        "district_overlap": f"""WITH {PLACED}, {DISTRICTS},
            t AS (SELECT DISTINCT postcode_district AS key FROM placed WHERE "is_london?" <> 'Outside London'),
            p AS (SELECT DISTINCT PostDist AS key FROM districts)
            SELECT key, 'transactions' AS only_in FROM (SELECT key FROM t EXCEPT SELECT key FROM p)
            UNION ALL SELECT key, 'polygons' FROM (SELECT key FROM p EXCEPT SELECT key FROM t)""",
        "low_volume_removed": f"WITH {district_trends}, {_FLAT_SQL}, {_KEPT} SELECT * FROM kept",
        "zone_selection": f"""WITH {district_trends}, {_FLAT_SQL}, {_KEPT} SELECT * FROM kept
            WHERE "is_london?" = 'Greater London'""",
        "hotspot_ranking": f"""WITH {district_trends}, {_FLAT_SQL}, {_KEPT},
            latest AS (SELECT postcode_district, property_type, roll_median_pct_5_year AS "5YearAvg%PriceInc"
                FROM kept WHERE year = {LATEST})
            SELECT * EXCLUDE (coef_var, iqr, median_mean_diff, median_mean_diff_pct, iqr_pct, lag_median_price,
                median_pct_change_1_year, roll_median_pct_2_year, is_good_sample),
                CAST(row_number() OVER (ORDER BY "5YearAvg%PriceInc" DESC NULLS LAST, postcode_district, property_type, year DESC)
                    AS BIGINT) AS position
            FROM kept JOIN latest USING (postcode_district, property_type)""",
        "type_counts_latest": _type_counts(f"year = {LATEST}"),
        "type_counts_all_years": _type_counts("true"),
        "type_counts_selected": _type_counts(f"postcode_district IN {_SELECTED_TRENDS}"),
        "socio_renamed": FACTS,
        "socio_polygons": f"""WITH {ZONES} SELECT * EXCLUDE (x0, y0, x1, y1), x0 AS min_x, y0 AS min_y, x1 AS max_x,
            y1 AS max_y, 27700 AS srid, (x1 - x0) * (y1 - y0) AS area FROM zones""",
        "socio_unmatched": """SELECT count(*) FILTER (WHERE c_custkey % 40 <> 0) AS matched,
            count(*) FILTER (WHERE c_custkey % 40 = 0) AS polygons_only,
            count(*) FILTER (WHERE c_custkey % 40 = 0) AS indicators_only FROM customer""",
        "spatial_within_inner": f"WITH {ZONES}, {DISTRICTS}, {PAIRS} SELECT LSOACode, PostDist FROM pairs",
        "spatial_within_left": f"""WITH {ZONES}, {DISTRICTS}
            SELECT LSOACode, PostDist FROM zones z LEFT JOIN districts d ON {INSIDE}""",
        "spatial_within_shapes": _shapes(),
        "spatial_within_detailed": f"""WITH {ZONES}, {DISTRICTS}
            SELECT LSOACode, PostDist FROM zones z JOIN districts d ON {INSIDE} AND z.y1 <= d.y1 - 0.5""",
        "spatial_shares": f"""WITH {ZONES}, {DISTRICTS}, {_SHARED}
            SELECT z.LSOACode, PostDist, size AS shared_area, size / ((z.x1 - z.x0) * (z.y1 - z.y0)) AS share
            FROM zones z LEFT JOIN shared USING (LSOACode)""",
        "spatial_shares_shapes": f"""WITH {ZONES}, squares AS (SELECT n_nationkey % 3 AS kind, {fx.select_list(fx.DISTRICT_BOXES)} FROM nation),
            taken AS (SELECT *, CASE kind WHEN 0 THEN x0 + 40 WHEN 1 THEN x0 + 40 ELSE x0 + 45 END AS tx0,
                CASE kind WHEN 0 THEN x0 + 60 WHEN 1 THEN x0 + 60 ELSE x0 + 55 END AS tx1,
                CASE kind WHEN 0 THEN y0 + 40 WHEN 1 THEN y0 + 60 ELSE y0 END AS ty0,
                CASE kind WHEN 0 THEN y0 + 60 ELSE y1 END AS ty1 FROM squares),
            sizes AS (SELECT LSOACode, PostDist, {_common('z', 'd', 'x0', 'y0', 'x1', 'y1')} - {_common('z', 'd', 'tx0', 'ty0', 'tx1', 'ty1')} AS shared_area
                FROM zones z, taken d)
            SELECT * FROM sizes WHERE shared_area > 0""",
        "population_by_share": f"""WITH {ZONES}, {DISTRICTS}, {_SHARED}
            SELECT PostDist, round(sum(TotalPopulation * (size / ((z.x1 - z.x0) * (z.y1 - z.y0)))), 4) AS TotalPopulation,
                round(sum(DependentChildren * (size / ((z.x1 - z.x0) * (z.y1 - z.y0)))), 4) AS DependentChildren
            FROM zones z JOIN shared USING (LSOACode) GROUP BY PostDist""",
        "district_area": f"""WITH {ZONES}, {DISTRICTS}
            SELECT 'district' AS layer, PostDist AS code, 10000.0::DOUBLE / 1000000 AS area_km2 FROM districts
            UNION ALL SELECT 'shaped', PostDist, CASE n_nationkey % 3 WHEN 0 THEN 9600.0::DOUBLE WHEN 1 THEN 9200.0::DOUBLE
                ELSE 9000.0::DOUBLE END / 1000000 FROM (SELECT n_nationkey, {fx.select_list(fx.DISTRICT_BOXES)} FROM nation)
            UNION ALL SELECT 'zone', LSOACode, (x1 - x0) * (y1 - y0) / 1000000 FROM zones""",
        "district_socio": f"WITH {ZONES}, {DISTRICTS}, {PAIRS}, {_socio()} SELECT * FROM socio",
        "district_trends_with_socio": f"{marts} SELECT * FROM joined",
        "mart_london_all": f"{marts} SELECT * FROM london",
        "zones_in_london": f"""{marts} SELECT LSOACode, PostDist FROM pairs
            WHERE PostDist IN (SELECT PostDist FROM london_flats)""",
        "mart_geometry": f"""{marts} SELECT {_names(_STATIC)}, 5 AS num_points FROM socio
            WHERE PostDist IN (SELECT PostDist FROM london_flats)""",
        "mart_series": f"{marts} SELECT {_names(_SERIES_MART)} FROM london_flats",
        "mart_rejoined": f"{marts} SELECT PostDist, {series}, {static} FROM london_flats f JOIN socio s USING (PostDist)",
        "first_values_per_district": f"""WITH {_level_stats('district')}, f AS (SELECT * FROM stats WHERE property_type = 'F')
            SELECT postcode_district, {', '.join(
                f"arg_min({c}, year) FILTER (WHERE {c} IS NOT NULL) AS {c}"
                for c in ["avg_price", "stddev_price", "skewness_price", "kurtosis_price"])}
            FROM f GROUP BY 1""",
        "price_graph": f"""{marts} SELECT DISTINCT postcode_district, year, avg_price, median_price, num_transactions
            FROM london""",
        "selection_bounds": f"""{marts}, b AS (SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x,
            max(y1) AS max_y FROM districts WHERE PostDist IN (SELECT PostDist FROM london_flats))
            SELECT *, (min_x + max_x) / 2 AS center_x, (min_y + max_y) / 2 AS center_y FROM b""",
        "choropleth_scale": f"""{marts}, d AS (SELECT min(avg_price) AS low, max(avg_price) AS high FROM joined)
            SELECT PostDist, property_type, year, avg_price AS value, (avg_price - low) / (high - low) AS scaled
            FROM joined, d""",
        "comparison_table": f"""{marts} SELECT postcode_district, property_type, avg_price, roll_median_pct_5_year,
            "CrimeAvg" FROM joined WHERE year = {LATEST} AND PostDist IN {_SELECTED}""",
        "price_series_selected": f"""WITH {district_trends} SELECT DISTINCT postcode_district, make_date(year, 1, 1) AS year,
            avg_price, median_price, num_transactions FROM trends WHERE postcode_district IN {_SELECTED_TRENDS}""",
        "scatter_rows": f'{marts} SELECT PostDist, "CrimeAvg" AS x, avg_price AS y FROM joined',
        "filter_options": f"""WITH {PLACED}, o AS (
            SELECT DISTINCT 'zone' AS option, "is_london?" AS value FROM placed
            UNION SELECT 'district', postcode_district FROM placed
            UNION SELECT 'property_type', property_type FROM placed
            UNION SELECT 'year', CAST(year AS VARCHAR) FROM placed)
            SELECT *, CAST(row_number() OVER (PARTITION BY option ORDER BY value) AS INTEGER) AS position FROM o""",
        "geojson_features": f"""WITH {ZONES} SELECT LSOACode, LADName, OverallScore, x0 AS min_x, y0 AS min_y,
            x1 AS max_x, y1 AS max_y, 27700 AS srid, (x1 - x0) * (y1 - y0) AS area, 5 AS num_points FROM zones""",
        "geometry_validity": f"""WITH {ZONES} SELECT LSOACode, CASE {flaw} WHEN 1 THEN 'Ring not closed' {flaws} END AS reason,
            CAST(CASE {flaw} WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS repeated_points FROM zones""",
        "geometry_repaired": f"""WITH {ZONES} SELECT LSOACode, CASE {flaw} {flaws} END AS reason, CAST(0 AS INTEGER) AS repeated_points,
            (x1 - x0) * (y1 - y0) * CASE {flaw} WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN 0.0::DOUBLE WHEN 5 THEN 0.0::DOUBLE
                WHEN 6 THEN 0.5::DOUBLE WHEN 8 THEN 0.75::DOUBLE WHEN 9 THEN 0.75::DOUBLE WHEN 10 THEN 0.0::DOUBLE
                WHEN 11 THEN 2.0::DOUBLE WHEN 12 THEN 0.6875::DOUBLE ELSE 1.0::DOUBLE END AS area FROM zones""",
        "geometry_interiors": f"""WITH {ZONES} SELECT LSOACode, CASE {cut} WHEN 2 THEN 'Valid' WHEN 3 THEN 'Coordinates not finite'
            WHEN 4 THEN 'Coordinates not finite' WHEN 6 THEN 'Valid' ELSE 'Interior is disconnected' END AS reason FROM zones""",
        "geometry_mended": f"""WITH {ZONES}, drawn AS (
            SELECT 'flawed ' || LSOACode AS LSOACode, (x1 - x0) * (y1 - y0) AS size,
                CASE {flaw} WHEN 4 THEN 'Zero area' WHEN 5 THEN 'Too few points' ELSE 'Valid' END AS reason,
                CASE WHEN {flaw} IN (3, 6) THEN 2 ELSE 1 END AS parts,
                CASE {flaw} WHEN 3 THEN 0.5 WHEN 6 THEN 0.5 WHEN 8 THEN 0.75 WHEN 10 THEN 0.75 WHEN 11 THEN 1.75 WHEN 12 THEN 0.75
                    ELSE 1 END AS share FROM zones
            UNION ALL SELECT 'cut ' || LSOACode, (x1 - x0) * (y1 - y0),
                CASE WHEN {cut} IN (3, 4) THEN 'Coordinates not finite' ELSE 'Valid' END, CASE WHEN {cut} IN (0, 1, 5) THEN 2 ELSE 1 END,
                CASE {cut} WHEN 0 THEN 0.75 WHEN 1 THEN 0.875 WHEN 2 THEN 0.875 WHEN 5 THEN 0.75 ELSE 1 END FROM zones)
            SELECT LSOACode, reason, CASE WHEN reason = 'Valid' THEN CAST(parts AS INTEGER) END AS num_parts,
                CASE WHEN reason = 'Valid' THEN size * share::DOUBLE END AS area FROM drawn""",
        "small_area_load": f"""WITH {ZONES} SELECT * EXCLUDE (x0, y0, x1, y1), x0 AS min_x, y0 AS min_y, x1 AS max_x,
            y1 AS max_y, 27700 AS srid, (x1 - x0) * (y1 - y0) AS area FROM zones""",
        "polygon_quarantine": f"""WITH {ZONES} SELECT LSOACode, CASE {flaw} {flaws} END AS reason, CAST(CASE {flaw} WHEN 3 THEN 5 WHEN 4 THEN 4
            WHEN 5 THEN 3 WHEN 6 THEN 7 WHEN 7 THEN 7 WHEN 12 THEN 15 ELSE 10 END AS INTEGER) AS num_points
            FROM zones WHERE {flaw} IN (3, 4, 5, 6, 7, 9, 10, 11, 12)""",
        "reproject_layer": _reprojection(
            """SELECT LSOACode, 4326 AS srid, CAST(i AS INTEGER) AS place, CASE WHEN i IN (1, 2) THEN x1 ELSE x0 END AS px,
                CASE WHEN i IN (2, 3) THEN y1 ELSE y0 END AS py FROM zones, range(5) AS r(i)""",
            "LSOACode, srid, place",
        ),
        "reproject_points": _reprojection(),
        "reproject_by_grid": _by_grid(),
        "geojson_document": f"""WITH {ZONES} SELECT LSOACode, LADName, OverallScore, x0 AS min_x, y0 AS min_y,
            x1 AS max_x, y1 AS max_y, 27700 AS srid, (x1 - x0) * (y1 - y0) AS area, 5 AS num_points FROM zones""",
    }
