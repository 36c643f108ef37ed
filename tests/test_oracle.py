"""Every query against its SQL twin; those without one give rows."""

import pytest
from oracle import DATA, differences

from gristmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLE_SQL:
        assert differences(df, catalogue.ORACLE_SQL[name], DATA) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
