import os
from collections import defaultdict

import pytest
from tests import sqlcheck

from lakewalk.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.TABLES), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, name):
    assert sqlcheck.compare(spark, sqlcheck.TABLES, queries.QUERIES[name], queries.SQL[name]) == ([], [])


def test_queries_over_empty_tables(spark, tmp_path):
    folder = sqlcheck.emptied(f"{tmp_path}/empty")
    for query in queries.QUERIES.values():
        query(spark, folder).count()


def test_medians_from_days_carry_their_rank_error(spark):
    values = defaultdict(list)
    for r in queries.table(spark, sqlcheck.TABLES, "inventory").filter("type = 2 AND size IS NOT NULL").collect():
        values[r["uid"]].append(r["size"])
    got = queries.p4_from_days(spark, sqlcheck.TABLES).collect()
    assert {x["uid"]: x["n"] for x in got} == {uid: len(sizes) for uid, sizes in values.items()}
    for x in got:
        sizes = values[x["uid"]]
        below, upto = (sum(ok) / len(sizes) for ok in ([s < x["median"] for s in sizes], [s <= x["median"] for s in sizes]))
        assert abs(x["rank_error"] - max(0, below - 0.5, 0.5 - upto)) < 1e-9
        assert x["rank_error"] <= queries.digest.RANK_ERROR
