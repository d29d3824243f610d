"""Comparison of queries with their SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

FOLDER = "/root/testdata/sf0.001"


def connect(folder: str = FOLDER):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(str(tuple(plain(r[k]) for k in order)) for r in rows)


def compare(spark, con, query, sql, folder: str = FOLDER) -> None:
    df = query(spark, folder)
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    a, b = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
