"""Compares registered queries with their SQL in DuckDB."""

import datetime
import glob
import os

import duckdb


def rows_of(rows):
    fix = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else x
    return sorted((tuple(fix(x) for x in r) for r in rows), key=repr)


def compare(query, sql, spark, folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    got = query(spark, str(folder))
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns), (names, got.columns)
    a, b = rows_of(got.select(*names).collect()), rows_of(want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
    return a
