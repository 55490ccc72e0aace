"""Every registered query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
from check import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
HEAVY = ("m4_", "m5_", "m13_")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(HEAVY)])
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        assert differences(df.columns, rows, [c[0] for c in cur.description], cur.fetchall()) is None
    else:
        assert rows
