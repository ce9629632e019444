"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest

from tidemark.queries import catalogue

QUERIES = {n: q for m in catalogue.MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).toArrow().num_rows > 0


def test_flagship(spark, data):
    assert catalogue.flagship(spark, data).count() == 5
