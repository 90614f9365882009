"""Row-for-row comparison of a registered query with its SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import tempfile
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    # Spill files of large comparisons stay out of the working folder.
    connection.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='oracle-')}'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(_plain(row[i])) for i in order) for row in rows)


def differences(spark, root: str, run, sql: str, connection=None) -> str | None:
    """None when equal, otherwise a short description of what differs."""
    df = run(spark, root)
    ours = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = (connection or duck(root)).execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = rows_of(names, result.fetchall())
    if ours == theirs:
        return None
    return (
        f"{ours.total()} against {theirs.total()} rows; only ours {list((ours - theirs).items())[:3]}; "
        f"only SQL {list((theirs - ours).items())[:3]}"
    )
