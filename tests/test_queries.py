"""Every core query on the smallest tables; those with SQL must give its rows."""

import pytest

from stenoflow.plans import registry

from .compare import duck, same

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE:
        same(df, con, ORACLE[name])
    else:
        assert df.columns
        df.write.format("noop").mode("overwrite").save()


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
