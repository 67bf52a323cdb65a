"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import pytest

from quillstream import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def canonical(table):
    names = sorted(table.column_names)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)
    return names, sorted(tuple(show(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = canonical(catalog.queries()[name](spark, SF).toArrow())
    if sql := catalog.oracle_sql().get(name):
        want = con.sql(sql).arrow()
        assert got == canonical(want.read_all() if hasattr(want, "read_all") else want)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
