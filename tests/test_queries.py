"""Every query of the catalogue agrees with its SQL."""

import pytest

from corpuslake.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(name, spark, sf_dir, agree):
    agree(QUERIES[name](spark, sf_dir), SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
