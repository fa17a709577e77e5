"""Rows of a query and of its SQL twin over one folder of tables."""

import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(v):
    if v is None:
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def rows_of_sql(sql):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        at = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from '{at}'")
    cols = sorted(con.sql(sql).columns)
    names = ", ".join(f'"{c}"' for c in cols)
    return cols, sorted(tuple(map(_norm, r)) for r in con.sql(f"select {names} from ({sql})").fetchall())
