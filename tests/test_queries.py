"""Every registered query over the smallest tables, against its SQL."""

import glob
import os

import pytest

from codicil import queries as Q

DATA = os.environ.get("CODICIL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(set(got)) or name.startswith(("valid_", "marred_", "page_exclusions"))
    if name in Q.SQL:
        want = duck.sql(Q.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_all_sql_has_a_query():
    assert set(Q.SQL) <= set(Q.queries())
