import pytest

from lodespark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(name, spark):
    from conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables here")
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
