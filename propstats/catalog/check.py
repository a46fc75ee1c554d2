"""Compare registered queries with their SQL on DuckDB: row counts, columns, types and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        # 0.0 and -0.0 must not pass as equal: the text of a value may be what is hashed.
        return repr(value)
    if isinstance(value, int):
        return value
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def compare(spark_df, connection, sql: str) -> tuple[list[str], int]:
    """Problems found (none when both results agree) and the rows Spark returned."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = rows_of(names, cursor.fetchall())
    got = rows_of(spark_df.columns, spark_df.collect())
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"], 0
    for name, spark_type in spark_df.dtypes:
        if _TYPES.get(spark_type) != types[name]:
            problems.append(f"type of {name}: {spark_type} against {types[name]}")
    if got != expected:
        missing, extra = expected - got, got - expected
        problems.append(
            f"{sum(expected.values())} rows expected, {sum(got.values())} got; "
            f"missing {list(missing)[:2]}, extra {list(extra)[:2]}"
        )
    return problems, sum(got.values())


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def main(argv: list[str]) -> int:
    """``python -m propstats.catalog.check SF_DIR [QUERY ...]``"""
    from propstats.catalog.oracle import oracle_sql
    from propstats.catalog.queries import queries
    from propstats.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    registered, sql = queries(), oracle_sql()
    failed = 0
    for name in wanted or registered:
        start = time.time()
        try:
            df = registered[name](spark, sf_dir)
            if name in sql:
                problems, rows = compare(df, connection, sql[name])
                note = f"{rows} rows"
            else:
                problems, note = [], f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
