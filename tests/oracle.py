"""Side-by-side run of a registered query in Spark and its SQL in DuckDB."""

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(picked, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


#: Spark type name to the DuckDB type that must stand against it
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def compare(spark, connection, folder, run, sql):
    """None when equal, else a description of the first difference."""
    df = run(spark, folder)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = {n: (t, duck_types[n]) for n, t in df.dtypes if TYPES.get(t) != duck_types[n]}
    if wrong:
        return f"types {wrong}"
    spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    duck_rows = _rows(names, cursor.fetchall())
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows != {len(duck_rows)} rows"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"{sorted(names)}\nspark {a}\nsql   {b}"
    return "empty result" if not spark_rows else None
