"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import glob
import os

import pytest

from docsmith.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def norm(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    sql = registry.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == columns
    want = sorted(tuple(map(norm, r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall())
    assert len(got) == len(want)
    assert all(a == b for a, b in zip(got, want))
