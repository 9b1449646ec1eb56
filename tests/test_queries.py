"""Every query that has SQL gives the same rows as DuckDB; the others give some."""

import pytest
from conftest import DATA, rows_of

from lumenframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_flagship(spark):
    rows = registry.flagship(spark, DATA).collect()
    assert (sum(r.n_images for r in rows), len(rows)) == (19, 11)
