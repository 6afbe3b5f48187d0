"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from conftest import SF

SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return check.open_tables(SF)


def test_every_query_but_the_approximate_one_has_sql():
    assert set(entry.q.QUERIES) - set(SQL) == {"knn_approx"}
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "doc_id", "score", "rank"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    check.compare(entry.queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).df())
