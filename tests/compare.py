"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_frame(text, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(text).fetch_df()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def same(frame, text, sf_dir):
    a, b = frame.toPandas(), sql_frame(text, sf_dir)
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
