import pytest

import __spark_entry__ as entry
from tests.compare import same
from tidebar.plans import catalogue

ROWS_ONLY = [n for n in catalogue.QUERIES if n not in catalogue.SQL]


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).toPandas().shape[0] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
