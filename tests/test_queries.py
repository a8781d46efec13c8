import pytest

from glyphlake.plans import catalog

from .helpers import SF, by_sql, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = by_sql(catalog.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
