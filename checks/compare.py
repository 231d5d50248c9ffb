"""Run the queries and their SQL side by side: python -m checks.compare [folder] [name …]"""

import sys
import time

import duckdb

from checks.queries import REGISTERED
from checks.sql import ORACLE
from lakesearch.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_integer_ratio"):
        return int(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, connection, folder: str, name: str, queries=REGISTERED, sql=ORACLE) -> list[str]:
    """Empty when the query and its SQL give the same columns and rows."""
    result = queries[name](spark, folder)
    got = _rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = connection.execute(sql[name])
    columns = [c[0] for c in cursor.description]
    expected = _rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(result.columns):
        return [f"columns {sorted(result.columns)} / {sorted(columns)}"]
    if not expected:
        return ["no rows"]
    if got == expected:
        return []
    extra, missing = set(map(repr, got)) - set(map(repr, expected)), None
    missing = set(map(repr, expected)) - set(map(repr, got))
    return [f"rows {len(got)} / {len(expected)}", *sorted(extra)[:3], *sorted(missing)[:3]]


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTERED)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in names:
        start = time.time()
        try:
            found = differences(spark, connection, folder, name)
        except Exception as error:  # reported per query, the others go on
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name} {'ok' if not found else 'DIFFERS'} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("   ", line[:400])


if __name__ == "__main__":
    main()
