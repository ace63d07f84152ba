"""DuckDB over the same tables, and the comparison of rows."""

import os


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')" if not os.path.isdir(path) else f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


def same_rows(df, con, sql):
    """Column names and rows, without order; floats to 9 digits."""
    got_cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    show = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(r[names.index(c)]) for c in got_cols) for r in cur.fetchall())
    got = sorted(tuple(show(r[c]) for c in got_cols) for r in df.collect())
    assert got_cols == sorted(names)
    assert got == want
