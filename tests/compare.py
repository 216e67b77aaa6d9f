"""Run a query and its SQL twin and compare them as the driver does: by column name, in any order."""

import datetime as dt

import duckdb


def _cell(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    return v.isoformat() if isinstance(v, dt.date) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_cell(r[i]) for i in order) for r in got.fetchall()), key=repr)
