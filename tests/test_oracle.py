"""Every named query against its check query on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _, _ = check_oracle.compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows only")) or verdict == "EMPTY", verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
