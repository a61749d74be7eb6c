"""The corpus queries that SQL can express, against that SQL."""

import duckdb
import pytest

from basalt.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_oracle(name, sf, spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())
