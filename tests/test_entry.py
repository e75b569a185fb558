import os

import pytest

import __spark_entry__ as entry
from scriptorium.plans import catalog, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() >= 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    cols, rows = compare.spark_rows(catalog.queries()[name](spark, FOLDER))
    other_cols, other = compare.duck_rows(duck, catalog.oracle_sql()[name])
    assert cols == other_cols and rows == other


@pytest.mark.parametrize("name", sorted(n for n in catalog.oracle_sql() if n.startswith(("sort_", "topk_"))))
def test_order_equals_that_of_its_sql(spark, duck, name):
    df, cur = catalog.queries()[name](spark, FOLDER), duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert [tuple(compare.plain(r[n]) for n in names) for r in df.collect()] == [tuple(map(compare.plain, r)) for r in cur.fetchall()]
