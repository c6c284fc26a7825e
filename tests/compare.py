"""Spark result against DuckDB's: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def difference(spark_df, relation):
    """None if both are alike, else what differs."""
    a_cols, b_cols = sorted(spark_df.columns), sorted(relation.columns)
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    a, b = rows(spark_df.columns, spark_df.collect()), rows(relation.columns, relation.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first of one only: {next((x for x in a if x not in set(b)), None)}, {next((x for x in b if x not in set(a)), None)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, such as {bad[0]}" if bad else None
