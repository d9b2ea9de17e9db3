"""Compare a query with its SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    return plain(float(value)) if hasattr(value, "as_integer_ratio") else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql, con):
    """None if the query and its SQL agree in columns and rows, else what differs first."""
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[r for r in a if r not in b][:2]} {[r for r in b if r not in a][:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}" if wrong else None
