import pytest

from lodespark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)
