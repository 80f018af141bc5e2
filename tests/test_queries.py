import pytest

import __spark_entry__
from passagework.plans.queries import QUERIES, SQL
from tests.oracle import connect, oracle_rows, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    names, got = rows_of(QUERIES[name](spark, SF))
    assert got == oracle_rows(connect(SF), SQL[name], names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
