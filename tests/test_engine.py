"""Statements of the dialect: tables, DML, MERGE, transactions, functions and errors."""

import pytest

from basalt.dialect import DialectError, translate
from basalt.engine import Engine
from basalt.functions.farm import fingerprint64


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def rows(engine, q):
    return [tuple(r) for r in engine.execute(q).collect()]


def test_dml_round(engine):
    engine.execute("CREATE TABLE t (id INT64 NOT NULL, name STRING, v INT64 DEFAULT 7)")
    assert engine.execute("INSERT INTO t (id, name) VALUES (1, 'a'), (2, NULL), (2, NULL)") == 3
    assert engine.execute("UPDATE t SET v = v + 1 WHERE name IS NULL") == 2
    assert engine.execute("DELETE FROM t WHERE name = 'a'") == 1
    assert rows(engine, "SELECT * FROM t") == [(2, None, 8), (2, None, 8)]
    with pytest.raises(Exception, match="required"):
        engine.execute("INSERT INTO t (v) VALUES (1)")
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(2,)]


def test_merge_clauses_and_double_match(engine):
    engine.execute("CREATE TABLE t AS SELECT * FROM UNNEST([1, 2, 3]) AS id")
    engine.execute("CREATE TABLE s AS SELECT 2 AS id UNION ALL SELECT 9")
    engine.execute("MERGE INTO t AS a USING s AS b ON a.id = b.id WHEN MATCHED THEN UPDATE SET id = a.id * 10 WHEN NOT MATCHED THEN INSERT (id) VALUES (id) WHEN NOT MATCHED BY SOURCE AND a.id = 3 THEN DELETE")
    assert sorted(rows(engine, "SELECT id FROM t")) == [(1,), (9,), (20,)]
    engine.execute("CREATE TABLE twice AS SELECT 1 AS id UNION ALL SELECT 1")
    with pytest.raises(ValueError, match="more than one"):
        engine.execute("MERGE INTO t AS a USING twice AS b ON a.id = b.id WHEN MATCHED THEN UPDATE SET id = 5")


def test_transaction_and_snapshot(engine):
    engine.execute("CREATE TABLE t AS SELECT 1 AS id")
    engine.execute("CREATE SNAPSHOT TABLE old CLONE t")
    engine.execute("BEGIN TRANSACTION")
    engine.execute("INSERT INTO t VALUES (2)")
    engine.execute("ROLLBACK")
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(1,)]
    engine.execute("TRUNCATE TABLE t")
    assert rows(engine, "SELECT id FROM old") == [(1,)]


def test_functions_procedures_scripts(engine):
    engine.execute("CREATE FUNCTION twice_it(x INT64) RETURNS INT64 AS (x * 2)")
    assert rows(engine, "SELECT twice_it(4)") == [(8,)]
    engine.execute('CREATE FUNCTION shout(s STRING) RETURNS STRING LANGUAGE python AS "def shout(s):\n  return s.upper()"'.replace("\n", "\n"))
    assert rows(engine, "SELECT shout('a')") == [("A",)]
    engine.execute("CREATE TABLE log AS SELECT 0 AS x")
    engine.execute("CREATE PROCEDURE add_one(n INT64) BEGIN INSERT INTO log VALUES (n); SELECT COUNT(*) AS n FROM log; END")
    assert [tuple(r) for r in engine.execute("CALL add_one(5)").collect()] == [(2,)]
    with pytest.raises(AssertionError, match="no rows"):
        engine.execute("ASSERT (SELECT COUNT(*) FROM log) > 99 AS 'no rows'")


def test_empty_ranges_and_null_rules(engine):
    got = rows(engine, "SELECT ARRAY_LENGTH(GENERATE_ARRAY(5, 1)), GREATEST(1, NULL), SAFE_DIVIDE(1, 0), SUBSTR('abc', -9), REGEXP_EXTRACT('x', r'\\d'), SAFE_CAST('q' AS INT64)")
    assert got == [(0, None, None, "abc", None, None)]


def test_null_order_follows_the_dialect(engine):
    assert rows(engine, "SELECT x FROM UNNEST([2, NULL, 1]) AS x ORDER BY x") == [(1,), (2,), (None,)]
    assert rows(engine, "SELECT x FROM UNNEST([2, NULL, 1]) AS x ORDER BY x DESC") == [(None,), (2,), (1,)]


def test_errors_are_plain():
    with pytest.raises(DialectError):
        translate("SELECT (1")
    with pytest.raises(DialectError):
        translate("SELECT FORMAT_DATE('%Q', d)")
    with pytest.raises(DialectError):
        translate("SELECT EXTRACT(TIMEZONE_HOUR FROM x)")


def test_fingerprint_known_values():
    assert fingerprint64(b"1footrue") == -1541654101129638711
    assert fingerprint64(b"2applefalse") == 2794438866806483259
    assert fingerprint64(b"3true") == -4880158226897771312


def test_plans_push_filters_and_prune_columns(spark):
    from basalt.plans import catalog

    plan = catalog.queries()["q1_pricing_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan
    assert "l_partkey" not in plan.split("ReadSchema")[-1]
    semi = catalog.queries()["join_semi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "LeftSemi" in semi and "CartesianProduct" not in semi


def test_recursive_union_distinct(engine):
    engine.execute("CREATE TABLE edges AS SELECT 1 AS a, 2 AS b UNION ALL SELECT 2, 3 UNION ALL SELECT 3, 1 UNION ALL SELECT 3, 4 UNION ALL SELECT 7, 8")
    walk = "WITH RECURSIVE reached AS (SELECT 1 AS n UNION {0} SELECT e.b FROM reached JOIN edges AS e ON e.a = reached.n) SELECT n, n AS reached FROM reached ORDER BY n"
    for word in ("DISTINCT", ""):  # the cycle ends, since known rows are dropped
        assert rows(engine, walk.format(word)) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    named = "WITH RECURSIVE roots AS (SELECT 7 AS r), pairs(x, y) AS (SELECT r, r FROM roots UNION DISTINCT SELECT p.x, e.b FROM edges e, pairs p WHERE e.a = p.y) SELECT p.x, y, r FROM roots, pairs AS p ORDER BY y"
    assert rows(engine, named) == [(7, 7, 7), (7, 8, 7)]
    assert [tuple(r) for r in engine.sql("WITH RECURSIVE k AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM k WHERE n < 3) SELECT SUM(n) FROM k").collect()] == [(6,)]
    assert not [t for t in engine.spark.catalog.listTables() if t.name.startswith("_recursive")]
