"""Order-free comparison of a Spark result with a SQL result."""

from __future__ import annotations

import datetime as dt
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(frame, connection, sql: str) -> str | None:
    """None when both results are the same, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    ours, theirs = _sorted(frame.columns, frame.collect()), _sorted(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(names)}: {str(a)[:700]} and {str(b)[:700]}"
    return None


def main(folder: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from redressa.session import build_session

    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            found = difference(frame, connection, sql[name]) if name in sql else f"no SQL, {frame.count()} rows"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:24} {time.time() - start:6.2f} s  {found or 'same'}", flush=True)


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    main(sys.argv[1], sys.argv[2:])
