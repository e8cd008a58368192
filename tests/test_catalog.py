"""Every named query against its SQL counterpart at the smallest scale."""

import pytest

import __spark_entry__
from check import difference, duck
from tallyward import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_sql_names_are_query_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"kmeans_clusters", "kmeans_candidates", "pca_variance", "pca_scores"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert difference(got, columns, cursor.fetchall()) is None


@pytest.mark.parametrize("name", ["pca_variance", "pca_scores"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
