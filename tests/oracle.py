"""Comparing a Spark result with DuckDB's on the same tables, without regard to row order."""
import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def difference(spark_df, con, sql):
    """None when the two agree, else what differs."""
    got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    want = table([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}; first {got[1][:2]} vs {want[1][:2]}"
    odd = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(odd)} rows differ: {odd[:2]}" if odd else None
