import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return db


@pytest.fixture(scope="session")
def same_rows():
    """Compare a Spark result with a DuckDB one: names, and values in any order."""
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def rows(df):
        df = df.reindex(sorted(df.columns), axis=1).astype(object)
        return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)

    def check(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
