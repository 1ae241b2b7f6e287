"""Every registered query against its SQL counterpart."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from redressa.workload.oracles import ORACLES
from redressa.workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, tables, name):
    frame = QUERIES[name](spark, FOLDER)
    assert difference(frame, tables, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[0] == "ticket_id" and frame.count() > 0
