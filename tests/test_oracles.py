"""Every query that has SQL, against DuckDB on the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from tests.verify import compare, connect

Q, S = entry.queries(), entry.oracle_sql()
#: Queries whose result is empty on the smallest tables.
EMPTY = {"over_value", "unseen_ids"}
CORE = [n for n in Q if not n.startswith(("p1_", "p4_", "p5_", "p7_", "p8_", "p9_"))]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, data, name):
    rows, ok, why = compare(spark, con, name, Q[name], S.get(name), data)
    assert ok is not False, why
    assert rows or name in EMPTY, "no rows"


def test_entry(spark):
    assert entry.entry(spark).columns == ["link", "node_id", "root_id", "depth"]


def test_names():
    assert set(S) <= set(Q)
