"""Compare a query with its SQL in DuckDB: same columns, same rows in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def _cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([_cell(x) for x in v])
    if v is None or pd.isna(v):
        return "NULL"
    if isinstance(v, (bool, np.bool_, str)):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def canonical(df):
    cols = sorted(df.columns)
    out = pd.DataFrame({c: [_cell(v) for v in df[c]] for c in cols}, dtype=object)
    return out.sort_values(cols).reset_index(drop=True) if len(out) else out


def assert_same(spark_df, db, sql):
    a, b = spark_df.toPandas(), db.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(canonical(a), canonical(b))
