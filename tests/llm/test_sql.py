"""Every query that has SQL against it, on the smallest directory."""

import duckdb
import pytest

from landq.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, cur.fetchall()))
