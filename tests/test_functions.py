"""Functions of the library that no registered query calls."""

import pytest

from basalt.engine import Engine


@pytest.mark.parametrize(
    "args,want",
    [("0, 1, 29, 25, 0, 0", (2, 0, 3600 * 10**6)), ("1, 0, 65, 49, 30, 0", (14, 7, 5400 * 10**6)), ("0, 0, -31, -25, 0, 0", (-1, -2, -3600 * 10**6)), ("0, 0, 0, 0, 0, 0", (0, 0, 0))],
)
def test_justify_interval_is_justify_days_of_justify_hours(spark, args, want):
    row = Engine(spark).sql(f"SELECT JUSTIFY_INTERVAL(MAKE_INTERVAL({args})) AS a, JUSTIFY_DAYS(JUSTIFY_HOURS(MAKE_INTERVAL({args}))) AS b").collect()[0]
    assert (row.a.months, row.a.days, row.a.micros) == want and row.a == row.b


@pytest.mark.parametrize(
    "sql,want",
    [
        ("3 + 1 = ANY (1, 4), 2 > ALL (1, 3), 5 <> ALL (1, 2), 2 < SOME (UNNEST([1, 3])), NULL = ANY (1), 1 = ANY (SELECT 1)", (True, False, True, True, None, True)),
        ("EXTRACT(NANOSECOND FROM TIMESTAMP '2024-06-15 14:30:45.123456'), EXTRACT(NANOSECOND FROM TIME '14:30:45.5')", (123456000, 500000000)),
        ("EXTRACT(HOUR FROM TIMESTAMP '2024-06-15 14:30:00 UTC' AT TIME ZONE 'America/New_York'), CAST(TIMESTAMP '2024-06-15 14:30:00 UTC' AT TIME ZONE 'Asia/Tokyo' AS STRING)", (10, "2024-06-15 23:30:00")),
        ("FORMAT('%t|%T|%T|%d%%', 5, 'x', DATE '2024-01-02', 7), FORMAT(\"%'d\", 1234567), FORMAT('%5t|', 'a'), FORMAT('%t', NULL)", ('5|"x"|DATE "2024-01-02"|7%', "1,234,567", "    a|", "NULL")),
        ("LENGTH(ST_ASBINARY(ST_GEOGPOINT(-122.4194, 37.7749))), ST_MAKEPOLYGON(ST_MAKELINE([ST_GEOGPOINT(0, 0), ST_GEOGPOINT(1, 0), ST_GEOGPOINT(1, 1), ST_GEOGPOINT(0, 0)]))", (24, "POLYGON((0 0, 1 0, 1 1, 0 0))")),
        ("ST_GEOMETRYTYPE(ST_BUFFERWITHTOLERANCE(ST_GEOGPOINT(0, 0), 1000, 10)), ST_GEOMETRYTYPE(ST_UNION('POLYGON((0 0, 1 0, 1 1, 0 0))', 'POLYGON((0 0, 2 0, 2 1, 0 0))'))", ("Polygon", "MultiPolygon")),
    ],
)
def test_values(spark, sql, want):
    assert tuple(Engine(spark).sql(f"SELECT {sql}").collect()[0]) == want


def test_quantified_comparison_in_where(spark):
    got = Engine(spark).sql("SELECT x FROM UNNEST([1, 2, 3]) AS x WHERE x = ANY (1, 3) AND x < 9 ORDER BY x").collect()
    assert [r.x for r in got] == [1, 3]
