import os

import pytest
from tests import sqlcheck

from lakewalk import pipeline_queries, queries, tree_queries

QUERIES = queries.QUERIES | tree_queries.QUERIES | pipeline_queries.QUERIES
SQL = queries.SQL | tree_queries.SQL | pipeline_queries.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.TABLES), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    assert sqlcheck.compare(spark, sqlcheck.TABLES, QUERIES[name], SQL[name]) == ([], [])


def test_queries_over_empty_tables(spark, tmp_path):
    folder = sqlcheck.emptied(f"{tmp_path}/empty")
    for query in QUERIES.values():
        query(spark, folder).count()
