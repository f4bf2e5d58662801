"""Every registered query of the core library against its SQL."""

import pytest

from compare import assert_same, connect
from linkloom.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def connections():
    return {s: connect(s) for s in ("/root/testdata/sf0.001", "/root/testdata/sf0.01")}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, connections, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), connections[sf].sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
