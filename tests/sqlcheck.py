"""Comparison of queries with their SQL over the tables of a folder."""

import os
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

TABLES = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def compare(spark, folder, query, sql):
    """Column names, and rows that only one side has."""
    connection = duckdb.connect()
    for name in os.listdir(folder):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    result = connection.execute(sql)
    names = [x[0] for x in result.description]
    expected = Counter(repr(tuple(map(plain, r))) for r in result.fetchall())
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    got = Counter(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    return list((got - expected).elements())[:3], list((expected - got).elements())[:3]


def emptied(folder):
    """The same tables without rows, and with columns whose names operators use inside."""
    os.makedirs(folder)
    for name in os.listdir(TABLES):
        table = pq.read_table(f"{TABLES}/{name}").slice(0, 0)
        for extra in ("k1", "rank", "part", "new", "value"):
            if extra not in table.column_names:
                table = table.append_column(extra, pa.array([], pa.string()))
        pq.write_table(table, f"{folder}/{name}")
    return folder
