"""Every query with SQL gives the rows of its SQL on the small test data; the others give rows."""

import os

import duckdb
import pytest
from oracle import compare, views

import __spark_entry__ as entry
from statuta.plans import catalogue

FOLDER = os.environ.get("STATUTA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


#: Queries that find nothing in the smallest tables, where no name stands in a document's text.
EMPTY_WHEN_SMALL = {"entity_detect", "term_rank", "term_rank_filtered"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    views(c, FOLDER)
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in catalogue.SQL:
        assert compare(df, catalogue.SQL[name], con) == ""
        assert name in EMPTY_WHEN_SMALL or con.sql(f"select count(*) from ({catalogue.SQL[name]})").fetchall()[0][0] > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "id", "rrf_score", "first_list", "rank"]


def test_sql_has_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
