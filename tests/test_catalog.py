"""Every query with SQL, side by side at the smallest scale."""

import os
from glob import glob

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    text = lambda x: "null" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[n]) for n in names) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    result = tables.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, got) == rows(names, [dict(zip(names, r, strict=True)) for r in result.fetchall()])
