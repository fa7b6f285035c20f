import pytest
from oracle import assert_same, connect

from gridweave.plans import catalog


@pytest.fixture(scope="module")
def db(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small_dir, db, name):
    df = catalog.queries()[name](spark, small_dir)
    if name in catalog.oracle_sql():
        assert_same(df, db, catalog.oracle_sql()[name])
    else:
        assert df.count() > 0
