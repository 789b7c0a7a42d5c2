"""Compare registered queries with their SQL, run by DuckDB on the same files.

As a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# DuckDB type to Spark type.
SAME_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _sortable(row: tuple) -> tuple:
    return tuple((value is not None, str(value)) for value in row)


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def compare(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    """Differences between a query and its SQL; empty if there are none."""
    result = query(spark, sf_dir)
    names = sorted(result.columns)
    spark_types = dict(result.dtypes)
    rows = [tuple(_plain(row[name]) for name in names) for row in result.collect()]
    cursor = con.execute(sql)
    found = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    order = [found.index(name) for name in sorted(found)]
    expected = [tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()]

    problems = []
    if names != sorted(found):
        return [f"columns {names} and {sorted(found)}"]
    for name in names:
        if SAME_TYPES.get(types[name]) != spark_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} and {types[name]}")
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows and {len(expected)}")
    rows.sort(key=_sortable)
    expected.sort(key=_sortable)
    differing = [(a, b) for a, b in zip(rows, expected) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, as in {str(differing[0])[:600]}")
    if not rows:
        problems.append("no rows")
    return problems


def main() -> None:
    from pyspark.sql import SparkSession

    from rolltally.catalog import ORACLES, QUERIES
    from rolltally.session import configure

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = configure(
        SparkSession.builder.master("local[8]"),
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                problems = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
            else:
                problems = [] if QUERIES[name](spark, sf_dir).collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001  (report and go on with the next)
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{len(wanted)} queries, {failed} failed")


if __name__ == "__main__":
    main()
