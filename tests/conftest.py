from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from prismspark.session import local_session

    session = local_session(4, 4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF_DIR}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query's rows with its SQL's, whatever their order."""

    def plain(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    def check(query, sql):
        frame = query(spark, SF_DIR)
        cols = sorted(frame.columns)
        mine = sorted(tuple(plain(r[c]) for c in cols) for r in frame.collect())
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
        assert mine == theirs

    return check
