import pytest
from oracle import agree, tables

from tesserlog.plans import catalogue, round_trips  # noqa: F401  (registers its queries)

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return tables(D)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL])
def test_query_equals_sql(spark, duck, name):
    agree(catalogue.QUERIES[name](spark, D), duck, catalogue.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
