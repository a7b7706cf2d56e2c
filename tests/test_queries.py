"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from caseflow.plans.oracles import ORACLES
from caseflow.plans.queries import QUERIES

from .compare import connect, differences




@pytest.fixture(scope="module")
def engine(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    result = engine.execute(ORACLES[name])
    assert differences(rows, df.columns, result.fetchall(), [d[0] for d in result.description]) == ""
