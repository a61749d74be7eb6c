"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

from basalt.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _plain(v):
    return ("nan" if v != v else repr(round(v, 8) + 0.0)) if isinstance(v, float) else repr(v)


def _rows(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted(tuple(_plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    r = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(sorted(names), df.columns, df.collect()) == _rows(sorted(names), names, r.fetchall())


def test_every_query_is_listed_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
