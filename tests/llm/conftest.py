import duckdb
import pytest


def rows_of(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture
def same_as_sql(spark):
    """Compares a query with its SQL over the tables of a folder."""

    def compare(name, folder):
        import glob
        import os

        from millrace.llm import queries

        db = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            source = f"{path}/*.parquet" if os.path.isdir(path) else path
            db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
        got = queries.QUERIES[name](spark, str(folder))
        want = db.execute(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        got_rows, want_rows = rows_of(got.select(*names).collect()), rows_of(want.fetchall())
        assert got_rows == want_rows
        return got_rows

    return compare
