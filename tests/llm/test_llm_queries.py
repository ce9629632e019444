"""The training-data queries against their SQL on the smallest tables; those without must run."""

import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, data):
    assert queries.QUERIES[name](spark, data).toArrow().num_rows >= 0


def test_entry_has_them():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
