"""Scripts over tables of the store, qualified names, and statements that once did nothing or the wrong thing."""

import pytest

from basalt.engine import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def rows(engine, q):
    return [tuple(r) for r in engine.execute(q).collect()]


def test_script_dml_goes_through_the_store(engine):
    engine.execute("CREATE TABLE t (id INT64 NOT NULL, v INT64 DEFAULT 7)")
    engine.execute("INSERT INTO t (id) VALUES (1)")
    engine.execute("CREATE SNAPSHOT TABLE s CLONE t")
    engine.execute("BEGIN TRANSACTION")
    engine.script("DECLARE k INT64 DEFAULT 2; WHILE k < 5 DO INSERT INTO t (id) VALUES (k); SET k = k + 1; END WHILE; UPDATE t SET v = k WHERE id = k - 1;")
    assert sorted(rows(engine, "SELECT id, v FROM t")) == [(1, 7), (2, 7), (3, 7), (4, 5)]
    assert rows(engine, "SELECT id, v FROM s") == [(1, 7)]
    engine.execute("ROLLBACK")
    assert rows(engine, "SELECT id, v FROM t") == [(1, 7)]
    with pytest.raises(Exception, match="required"):
        engine.script("DECLARE k INT64; INSERT INTO t (id) VALUES (k);")


def test_script_control_flow(engine):
    out = engine.script("""
        DECLARE total INT64 DEFAULT 0; DECLARE a, b INT64; DECLARE name STRING DEFAULT 'n is';
        SET (a, b) = (1, 2);
        FOR r IN (SELECT x FROM UNNEST([3, 4, 5]) AS x ORDER BY x) DO
          IF r.x = 4 THEN CONTINUE; ELSEIF r.x > 9 THEN BREAK; ELSE SET total = total + r.x; END IF;
        END FOR;
        LOOP SET a = a + 1; IF a > 3 THEN LEAVE; END IF; END LOOP;
        REPEAT SET b = b * 2; UNTIL b > 10 END REPEAT;
        CASE WHEN a = 4 THEN SET name = 'four'; ELSE SET name = 'other'; END CASE;
        BEGIN DECLARE total INT64 DEFAULT 99; SET total = 100; END;
        SELECT total AS total, a AS a, b AS b, name AS name, CASE WHEN a = 4 THEN 1 END AS c;
        RETURN; SELECT 1;""")
    assert [tuple(r) for r in out[0].collect()] == [(8, 4, 16, "four", 1)] and len(out) == 1


def test_exceptions_and_raise(engine):
    out = engine.script("BEGIN SELECT 1 AS x; RAISE USING MESSAGE = 'it''s wrong'; EXCEPTION WHEN ERROR THEN SELECT @@error.message AS m; END;".replace("''", "\\'"))
    assert out[1].first().m == "it's wrong"
    with pytest.raises(RuntimeError, match="again"):
        engine.script("BEGIN RAISE USING MESSAGE = 'again'; EXCEPTION WHEN ERROR THEN RAISE; END;")


def test_procedures_take_and_give_values(engine):
    engine.execute("CREATE PROCEDURE twice(n INT64, OUT r INT64, OUT s STRING) BEGIN SET r = n * 2; SET s = 'n is'; END")
    out = engine.script("DECLARE x INT64 DEFAULT 5; DECLARE y INT64; DECLARE z STRING; CALL twice(x + 1, y, z); SELECT x AS x, y AS y, z AS z;")
    assert [tuple(r) for r in out[-1].collect()] == [(5, 12, "n is")]


def test_qualified_names_and_schemas(engine):
    engine.execute("CREATE SCHEMA ds")
    engine.execute("CREATE TABLE ds.t (id INT64, name STRING)")
    engine.execute("INSERT INTO `p.ds.t` VALUES (1, 'a'), (2, DEFAULT)")
    engine.execute("INSERT INTO ds.t (id) VALUES (3)")
    assert engine.execute("UPDATE ds.t SET name = 'z' WHERE id = 3") == 1
    assert rows(engine, "SELECT t.id, x.name FROM ds.t JOIN p.ds.t AS x ON t.id = x.id WHERE t.id > 1 ORDER BY id") == [(2, None), (3, "z")]
    engine.execute("CREATE VIEW IF NOT EXISTS ds.v AS SELECT COUNT(*) AS n FROM ds.t")
    engine.execute("CREATE VIEW IF NOT EXISTS ds.v AS SELECT 99 AS n")
    assert rows(engine, "SELECT n FROM ds.v") == [(3,)]
    with pytest.raises(ValueError, match="not empty"):
        engine.execute("DROP SCHEMA ds")
    engine.execute("DROP SCHEMA ds CASCADE")
    with pytest.raises(Exception, match="ds"):
        rows(engine, "SELECT * FROM ds.t")
    engine.execute("UNDROP SCHEMA ds")
    assert rows(engine, "SELECT COUNT(*) FROM ds.t") == [(3,)]


def test_nested_and_unknown_columns(engine):
    engine.execute("CREATE TABLE t AS SELECT 1 AS id, STRUCT(1 AS a, 'x' AS b) AS s")
    assert engine.execute("UPDATE t SET s.a = 9 WHERE id = 1") == 1
    assert rows(engine, "SELECT s.a, s.b FROM t") == [(9, "x")]
    for wrong in ("nosuch = 1", "s.nosuch = 1"):
        with pytest.raises(ValueError, match="nosuch"):
            engine.execute(f"UPDATE t SET {wrong} WHERE TRUE")
    engine.execute("CREATE SNAPSHOT TABLE IF NOT EXISTS old CLONE t")
    engine.execute("CREATE SNAPSHOT TABLE IF NOT EXISTS old CLONE t")
    assert rows(engine, "SELECT id FROM old") == [(1,)]
    engine.execute("ALTER TABLE t ADD COLUMN w INT64")
    engine.execute("ALTER TABLE t ALTER COLUMN w SET DEFAULT 4")
    engine.execute("INSERT INTO t (id) VALUES (2)")
    assert rows(engine, "SELECT w FROM t WHERE id = 2") == [(4,)]
    with pytest.raises(ValueError, match="nulls"):
        engine.execute("ALTER TABLE t ALTER COLUMN w SET NOT NULL")
    engine.execute("ALTER TABLE t ALTER COLUMN id SET NOT NULL")
    with pytest.raises(Exception, match="required"):
        engine.execute("INSERT INTO t (w) VALUES (2)")


def test_functions_of_tables_and_aggregates(engine):
    engine.execute("CREATE TABLE t AS SELECT x AS id FROM UNNEST([1, 2, 3, 4]) AS x")
    engine.execute("CREATE TABLE FUNCTION upto(n INT64) AS SELECT id FROM t WHERE id <= n")
    assert sorted(rows(engine, "SELECT id FROM upto(2)")) == [(1,), (2,)]
    engine.execute("CREATE AGGREGATE FUNCTION spread(v INT64) AS (MAX(v) - MIN(v))")
    assert rows(engine, "SELECT spread(id * 2) FROM t") == [(6,)]
    assert rows(engine, "SELECT APPROX_TOP_COUNT(v, 1) FROM UNNEST([5, 5, 7]) AS v")[0][0][0].asDict() == {"value": 5, "count": 2}


def test_gap_fill_and_samples_in_from(engine):
    engine.execute("CREATE TABLE d AS SELECT DATETIME '2023-11-01 09:34:01' AS time, 74 AS signal UNION ALL SELECT DATETIME '2023-11-01 09:36:00', 77 UNION ALL SELECT DATETIME '2023-11-01 09:37:00', 78")
    got = rows(engine, "SELECT * FROM GAP_FILL(TABLE d, ts_column => 'time', bucket_width => INTERVAL 1 MINUTE, value_columns => [('signal', 'locf')]) ORDER BY time")
    assert [(t.minute, v) for t, v in got] == [(35, 74), (36, 77), (37, 78)]
    assert rows(engine, "SELECT COUNT(*) FROM d TABLESAMPLE SYSTEM (100 PERCENT)") == [(3,)]


def test_functions_that_were_wrong(engine):
    got = rows(engine, "SELECT ARRAY_SLICE([1, 2, 3, 4, 5], 2, 4), ARRAY_SLICE([1, 2, 3], -2, 3), ARRAY_SLICE([1, 2, 3], 1, -1), ARRAY_SLICE([1, 2], 3, 1), SPLIT('abc', ''), SUBSTRING('abcd' FROM 2 FOR 2), SAFE.PARSE_DATE('%Y-%m-%d', 'x')")
    assert got == [([2, 3, 4], [2, 3], [1, 2], [], ["a", "b", "c"], "bc", None)]
    got = rows(engine, "SELECT JSON_VALUE(PARSE_JSON('{\"a\": 1}'), '$.a'), TO_JSON_STRING(1), TO_JSON_STRING('x'), TO_JSON_STRING([1, 2]), JSON_VALUE(TO_JSON(STRUCT(3 AS b)), '$.b'), TRUNCATE(1.57, 1)")
    assert got == [("1", "1", '"x"', "[1,2]", "3", 1.5)]


def test_recursion_over_nulls_ends(spark):
    from pyspark.sql import functions as F

    from basalt.operators.relations import recursive_union

    seed = spark.createDataFrame([(1, None)], "a int, b int")
    assert [tuple(r) for r in recursive_union(seed, lambda d: d.select("a", F.col("b")), 5).collect()] == [(1, None)]
