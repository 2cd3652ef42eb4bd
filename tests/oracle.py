"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(rows, columns):
    value = lambda x: repr(round(float(x), 6) + 0.0) if isinstance(x, float) else repr(x)
    return sorted(tuple(value(r[c]) for c in sorted(columns)) for r in rows)


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows_of([r.asDict(recursive=True) for r in df.collect()], df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    theirs = rows_of([dict(zip(got.columns, r)) for r in got.fetchall()], got.columns)
    return sorted(df.columns), ours, sorted(got.columns), theirs
