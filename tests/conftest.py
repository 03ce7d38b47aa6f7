import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugeweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


def same_rows(df, duck, sql):
    """Asserts that a DataFrame and a DuckDB query have the same columns and rows, in any order."""

    def plain(v):
        if isinstance(v, float):
            return None if v != v else float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    rel = duck.sql(sql)
    columns = list(rel.columns)
    assert sorted(columns) == names
    want = sorted(repr(tuple(plain(r[columns.index(n)]) for n in names)) for r in rel.fetchall())
    assert got == want
