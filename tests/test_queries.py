"""Every query of the core runs, and agrees with its SQL."""

import pytest

from corpuskiln.plans import catalogue

from .compare import rows_of, rows_of_sql


def test_sql_has_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, duck, sf_dir, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() >= 0
