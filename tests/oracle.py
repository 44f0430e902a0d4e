"""Compares a query's rows with those that DuckDB gives for its SQL, whatever their order."""

import glob
import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(round(x, 6))
    return str(x)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql):
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
