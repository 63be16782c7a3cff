"""Rows of a Spark query against those of its SQL in DuckDB."""

import glob
import os

import duckdb

TESTDATA = "/root/testdata"


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = c.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    return names, sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=repr)


def rows_of_query(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    a, b = rows_of_query(query(spark, sf_dir)), rows_of_sql(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows: {a[1][:2]} {b[1][:2]}"
    kinds = {type(x) for r in a[1][:50] for x in r} ^ {type(x) for r in b[1][:50] for x in r}
    wrong = [(p, q) for p, q in zip(a[1], b[1]) if p != q]
    return f"{len(wrong)} rows differ, as {wrong[0]}" if wrong else f"types {kinds}" if kinds else ""
