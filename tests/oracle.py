"""Compare a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(df, cols):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 8)
        return v.item() if hasattr(v, "item") else v

    out = [tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    # whole numbers that pandas holds as floats because of nulls
    return sorted(repr(tuple(int(v) if isinstance(v, float) and v.is_integer() else v for v in r)) for r in out)


def assert_same(spark_df, sql, con):
    got, want = spark_df.toPandas(), con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)
