"""Compare a query with its SQL on DuckDB, as multisets of rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return Counter(tuple(str(clean(r[i])) if r[i] is not None else None for i in order) for r in rows)


def oracle(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.execute(sql)
    return [x[0] for x in r.description], r.fetchall()


def difference(df, sf_dir, sql):
    columns, rows = oracle(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(columns)} / {sorted(df.columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    return None if a == b else f"spark only {list((a - b).items())[:3]}, sql only {list((b - a).items())[:3]}"
